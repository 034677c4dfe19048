"""Small dimension tables. Their sizes are fixed by definition, not by the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oligoweave.functions import constants as C
from oligoweave.functions.sequence import iupac_compatible, iupac_match_probability, reverse_complement


def iupac_pairs(spark: SparkSession) -> DataFrame:
    """17 x 17 code pairs with match probability and compatibility."""
    codes = spark.createDataFrame([(c,) for c in C.IUPAC_OPTIONS], "b1 string")
    pairs = codes.withColumn("b2", F.explode(F.array(*[F.lit(c) for c in C.IUPAC_OPTIONS])))
    return pairs.select(
        "b1",
        "b2",
        iupac_match_probability("b1", "b2").alias("probability"),
        iupac_compatible("b1", "b2").alias("compatible"),
    )


def conservation_weights(spark: SparkSession, shortest: int = 5, longest: int = 100) -> DataFrame:
    """(len, weights) of a range of lengths."""
    return spark.range(shortest, longest + 1).select(F.col("id").cast("int").alias("len")).select(
        "len", weights_of(F.col("len")).alias("weights")
    )


def weights_of(n: Column) -> Column:
    """Weights of a region of n bases: the last five share half of the weight, more in short primers.

    Within the last five the share grows as ((x + 3) / 6) ^ (x + 3) + 1; the rest is even. A
    region of fewer than five has the end of that curve, scaled to the whole weight.
    """
    short = F.when(n <= 15, (n - 5) / 10.0).otherwise(F.lit(1.0))
    tail_share = 0.5 * (2 - short)
    head_share = 0.5 * short
    curve = [((x + 3) / 6) ** (x + 3) + 1 for x in range(5)]
    tail = F.transform(
        F.array(*[F.lit(v) for v in curve]), lambda v: v * (tail_share / sum(curve))
    )
    head = F.when(n > 5, F.array_repeat(head_share / (n - 5), (n - 5).cast("int"))).otherwise(
        F.array().cast("array<double>")
    )
    few = F.slice(F.array(*[F.lit(v) for v in curve]), 6 - n, n)
    scaled = F.transform(few, lambda v: v / F.aggregate(few, F.lit(0.0), lambda a, x: a + x))
    return F.when(n >= 5, F.concat(head, tail)).otherwise(scaled)


def arrangements(spark: SparkSession, states: int, positions: int) -> DataFrame:
    """(perm_id, perm): ordered picks without repetition, in lexicographic order."""
    rows: list[list[int]] = [[]]
    for _ in range(positions):
        rows = [row + [s] for row in rows for s in range(states) if s not in row]
    return spark.createDataFrame(list(enumerate(rows)), "perm_id int, perm array<int>")


def latin_round(f: str, r: str, n: int):
    """Round in which cell (f, r) is visited when each round touches a row and column once."""
    return F.pmod(F.col(r) - F.col(f), F.lit(n))


# Published primer sets (name, forward bindings, reverse bindings, forward
# adapter, reverse adapter). Reverse bindings marked True are stored as the forward strand.
_FA = "ACACTCTTTCCCTACACGACGCTCTTCCGATCT"
_RA = "GTGACTGGAGTTCAGACGTGTGCTCTTCCGATCT"
GENSETS = [
    ("Standard", [_FA], [_RA], False,
     "GTCAACCCAGCAGCTTACGCTGCCCTGGGTGCCGC", "TGTGGCTTGGTGGATCTTCACACATCAGGGCTCTGAT"),
    ("Random Rho",
     ["GTCAACCCAGCAGCTTACGCTGCCCTGGGTGCCTACA", "TCACCACAACGATGTACACCTCCATGCAC",
      "CTTGGCTGCAATCTGGAAGGATTCTTTGC", "TCTCTGGTCACTGGTCGTTCTGGCTATTG",
      "AGCCCATCAGCAACTTCCGCTTCGGAGAG", "AACTACATCCTGCTGAATCTCGCGGTGGCCGACC"],
     ["TGTGGCTTGGTGGATCTTCACACATCAGGGCTCTGAT", "TTTGCCAAGAGTTCCTCCATCTACAACCC",
      "AGACCACCCAGAGGGCTGAGAGGGAAG", "ATCATCATGGTCTTCGCCTTCCTGATG",
      "CCGAGACCACCCAGAGGGCTGAGAGGGAA", "AATTGTGTTCTTCTGCTACGGCCGTCTGCTGTGCGCC"], True,
     "GTCAACCCAGCAGCTTACGCTGCCCTGGGTGCCGC", "TGTGGCTTGGTGGATCTTCACACATCAGGGCTCTGAT"),
    ("Small Binding", ["GTCAA", "TCACC", "CTTGG", "TCTCT", "AGCCC", "AACTA"],
     ["TGTGG", "TTTGC", "AGACC", "ATCAT", "CCGAG", "AATTG"], True, "ACACT", "GTGAC"),
    ("Optimal Set", ["CGTATCCCGAATTAGCCAGTTTGGATGGGT"], ["ACATCTTCCTTCACAGGGTTCCAGTCACCA"], False,
     "TTTAGGACCGGGGAATCGGTAGGCGAACGA", "CTAGTGCTACGGAGTAGGCATTTATATTTA"),
    ("HuRho_1", ["GTCATCTTCTTCTGCTACG"], ["GCCGGAATGGTCATGAAGA"], False, _RA, _FA),
    ("EnviRho_1", ["GAGTCCTTCGTCATCTACATG"], ["AGGGTGGTGATCATGCAG"], False, _RA, _FA),
    ("Mitofish_UF", ["GTCGGTAAAACTCGTGCCAGC"], ["CATAGTGGGGTATCTAATCCCAGTTTG"], False, _RA, _FA),
    ("Teleo", ["ACACCGCCCGTCACTCT"], ["CTTCCGGTACACTTACCATG"], False, _RA, _FA),
    ("ITS", ["CTTGGTCATTTAGAGGAAGTAA"], ["GCTGCGTTCTTCATCGATGC"], False, _RA, _FA),
    ("sixteen", ["SGCCTGTTTACCAAAAACATCAC"], ["CTCCATAGGGTCTTCTCGTCTT"], False, _RA, _FA),
]


def template_sets(spark: SparkSession) -> DataFrame:
    """genset(name, i, f_bind, r_bind, f_adapt, r_adapt)."""
    raw = spark.createDataFrame(
        GENSETS,
        "name string, fb array<string>, rb array<string>, flip boolean, f_adapt string, r_adapt string",
    )
    return raw.select(
        "name", "flip", "f_adapt", "r_adapt", F.posexplode(F.arrays_zip("fb", "rb")).alias("i", "b")
    ).select(
        "name",
        "i",
        F.col("b.fb").alias("f_bind"),
        F.when(F.col("flip"), reverse_complement(F.col("b.rb"))).otherwise(F.col("b.rb")).alias("r_bind"),
        "f_adapt",
        "r_adapt",
    )
