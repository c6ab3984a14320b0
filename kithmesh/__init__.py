"""kithmesh: similarity, structure and diffusion analytics as lazy PySpark operators."""
