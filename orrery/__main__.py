"""python -m orrery STAGE."""

from .plans.stages import main

main()
