"""Fixed values of the formulas."""

R = 8.314  # gas constant, J/(mol K)
K_B = 1.380649e-23  # Boltzmann constant, J/K
N_A = 6.022e23  # Avogadro's number, 1/mol
TINY = 1e-15  # below it a divisor counts as zero
HUGE = 1e10  # stands for a ratio over such a divisor
