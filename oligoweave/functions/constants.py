"""Fixed values. They are stated as published, in natural order."""

# IUPAC nucleotide codes and the bases each may stand for.
# "I" is the local code for "ignore this base": it stands for nothing.
IUPAC_OPTIONS = {
    "A": "A",
    "C": "C",
    "T": "T",
    "G": "G",
    "U": "U",
    "W": "AT",
    "S": "CG",
    "M": "AC",
    "K": "GT",
    "R": "AG",
    "Y": "CT",
    "B": "CGT",
    "D": "AGT",
    "H": "ACT",
    "V": "ACG",
    "N": "ACGT",
    "I": "",
}

# Complement of every IUPAC code, position by position.
COMPLEMENT_FROM = "ATCGURYSWKMBDHVN"
COMPLEMENT_TO = "TAGCAYRSWMKVHDBN"

# Fixed value: the order in which ties between bases are broken.
BASES = "ATCG"

# Oligo length limit of the thermodynamic model, 3' end kept.
SOLVER_LIMIT = 60
# Conservation threshold of a region warning, in percent.
LOW_CONSERVATION = 85.0
# Overlap dimer score weights and scale.
RUN_WEIGHT = 3
TOTAL_WEIGHT = 1
OVERLAP_SCALE = 12
# Exponents of the region penalty.
CONSERVATION_EXPONENT = 2
DIMER_EXPONENT = 1
# Weights of the spacer-combination criteria.
COMBO_MAX_WEIGHT = 4
COMBO_SUM_WEIGHT = 1
COMBO_DISTINCT_WEIGHT = 4
# Variance divisor of a set score, energy criterion weights.
VARIANCE_DIVISOR = 3
HAIRPIN_WEIGHT = 1
HOMODIMER_WEIGHT = 4
HETERODIMER_WEIGHT = 1
# Binding search.
KEEP_PER_TARGET = 1000
CONSERVATION_LOSS = 0.2
RETRY_PERCENT = 25
WORST_SHARE = 0.25
GC_ZONE = 2
# Sampling sizes at rigour 0.
INITIAL_SETS = 1000
INITIAL_PAIRINGS = 35

# SantaLucia (PNAS 1998) unified nearest-neighbour parameters.
# dinucleotide step: (dH in 0.1 kcal/mol, dS in 0.1 cal/mol/K, dG37 in 0.01 kcal/mol)
NEAREST_NEIGHBOUR = {
    "AA": (-79, -222, -100),
    "AT": (-72, -204, -88),
    "TA": (-72, -213, -58),
    "CA": (-85, -227, -145),
    "GT": (-84, -224, -144),
    "CT": (-78, -210, -128),
    "GA": (-82, -222, -130),
    "CG": (-106, -272, -217),
    "GC": (-98, -244, -224),
    "GG": (-80, -199, -184),
}
# Initiation per terminal pair (same units) and symmetry entropy.
TERMINAL_GC = (1, -28)
TERMINAL_AT = (23, 41)
SYMMETRY_ENTROPY = -14
# Gas constant, salt coefficient, default oligo and salt molarity.
GAS_CONSTANT = 1.987
SALT_COEFFICIENT = 0.368
OLIGO_MOLAR = 5e-8
SODIUM_MOLAR = 0.05
KELVIN = 273.15
# Fixed value: fewest unpaired bases in a hairpin loop.
MIN_LOOP = 3


def step_table() -> dict[str, tuple[int, int, int]]:
    """All 16 dinucleotide steps: each published step and its reverse complement."""
    swap = str.maketrans("ATCG", "TAGC")
    table = dict(NEAREST_NEIGHBOUR)
    for step, values in NEAREST_NEIGHBOUR.items():
        table[step.translate(swap)[::-1]] = values
    return table
