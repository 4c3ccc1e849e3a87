"""Column functions on the satellite grid and on annealing schedules."""
