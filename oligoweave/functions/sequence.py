"""Sequence functions as Column builders.

Every function here returns an expression over string columns, so a score is computed
where the row already is: no explode, no shuffle, no Python worker.

Alignments of two oligos are compared on bit masks. A sequence of up to 63 bases is
held as one 64-bit mask per base (first base = highest bit); sliding one oligo along
another is then a shift, base pairing an AND, and counting matches a population
count. Longer sequences take an equivalent path over arrays of option sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from oligoweave.functions import constants as C

MASK_LIMIT = 63
_CODES = "".join(C.IUPAC_OPTIONS) + "-"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shl(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits.cast("int"))


def _shr(value: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, bits.cast("int"))


def _popcount(value: Column) -> Column:
    return F.bit_count(value)


# --- single sequences -------------------------------------------------------------


def complement(seq: Column | str) -> Column:
    return F.translate(F.upper(_col(seq)), C.COMPLEMENT_FROM, C.COMPLEMENT_TO)


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def is_plain_dna(seq: Column | str) -> Column:
    """Only A, T, C, G in any case; the empty sequence counts as plain."""
    return ~_col(seq).rlike("[^ATCGatcg]")


def is_degenerate(seq: Column | str) -> Column:
    return _col(seq).rlike("[^ATCG]")


def mask_degenerate(seq: Column | str) -> Column:
    return F.regexp_replace(_col(seq), "[^ATCG]", "I")


def trim_to_solver_limit(seq: Column | str, limit: int = C.SOLVER_LIMIT) -> Column:
    """Keep the 3'-most bases."""
    return F.right(_col(seq), F.lit(limit))


def binding_forward(consensus: Column | str, five_p: Column | str, length: Column | str) -> Column:
    return F.substring(_col(consensus), _col(five_p) + 1, _col(length))


def binding_reverse(consensus: Column | str, five_p: Column | str, length: Column | str) -> Column:
    """The reverse primer covers [5' - length + 1, 5'] and reads the other strand."""
    start = _col(five_p) - _col(length) + 2
    return reverse_complement(F.substring(_col(consensus), start, _col(length)))


def flip_coordinate(index: Column | str, size: Column | str) -> Column:
    """Index seen from the other end; NULL where the index lies beyond the size."""
    index, size = _col(index), _col(size)
    return F.when((index <= size) & (size >= 0), size - index - 1)


def gc_fraction(seq: Column | str) -> Column:
    seq = _col(seq)
    return F.when(F.length(seq) > 0, F.regexp_count(seq, F.lit("[GC]")) / F.length(seq))


def gc_band(seq: Column | str, bands: int = 10) -> Column:
    """Equal-width band of the GC fraction, 0-based; all-GC falls in the last band."""
    return F.least(F.floor(gc_fraction(seq) * bands), F.lit(bands - 1)).cast("int")


def has_gc_end(seq: Column | str) -> Column:
    return F.right(_col(seq), F.lit(C.GC_ZONE)).rlike("[GC]")


def gc_clamp(forward: Column | str, reverse: Column | str) -> Column:
    return has_gc_end(forward) & has_gc_end(reverse)


def assemble_primer(adapter, index, spacer, binding) -> Column:
    return F.upper(F.concat(_col(adapter), _col(index), _col(spacer), _col(binding)))


# --- bit masks --------------------------------------------------------------------


def _marks(seq: Column, codes: set[str]) -> Column:
    """The sequence as a string of 1 (one of the codes) and 0."""
    return F.translate(seq, _CODES, "".join("1" if code in codes else "0" for code in _CODES))


def _bits(marks: Column) -> Column:
    return F.coalesce(F.conv(marks, 2, 10).cast("bigint"), F.lit(0).cast("bigint"))


def _codes_of(base: str) -> set[str]:
    return {code for code, options in C.IUPAC_OPTIONS.items() if base in options}


def encode_overlap(seq: Column | str) -> Column:
    """An oligo made ready for overlap scores; encode once, compare many times.

    ``l0..l3`` mark where A, T, C, G are options, ``s0..s3`` the same for the reverse
    complement. Oligos too long for a mask keep their string only.
    """
    seq = F.upper(_col(seq))

    def build(v: Column) -> Column:
        partner = {0: 1, 1: 0, 2: 3, 3: 2}
        return F.struct(
            v["seq"].alias("seq"),
            F.length(v["seq"]).alias("n"),
            *[_bits(v[f"t{i}"]).alias(f"l{i}") for i in range(4)],
            *[_bits(F.reverse(v[f"t{partner[i]}"])).alias(f"s{i}") for i in range(4)],
        )

    short = F.when(F.length(seq) <= MASK_LIMIT, seq).otherwise("")
    marks = [_marks(short, _codes_of(base)).alias(f"t{i}") for i, base in enumerate(C.BASES)]
    return let(F.struct(seq.alias("seq"), *marks), build)


def encode_energy(seq: Column | str) -> Column:
    """An oligo made ready for dimer energies: masks and running stack energy.

    ``l0`` marks plain bases, ``l1`` and ``l2`` tell the four bases apart; ``s*`` hold the
    reverse complement, in which T/G and A/C change places and C/G stay. Oligos too long for
    a mask are compared by their bases.
    """
    seq = _col(seq)

    def build(v: Column) -> Column:
        plain = _bits(F.reverse(v["t0"]))
        return F.struct(
            v["seq"].alias("seq"),
            F.length(v["seq"]).alias("n"),
            *[_bits(v[f"t{i}"]).alias(f"l{i}") for i in range(3)],
            plain.alias("s0"),
            plain.bitwiseXOR(_bits(F.reverse(v["t1"]))).alias("s1"),
            _bits(F.reverse(v["t2"])).alias("s2"),
            _energy_prefix(v["seq"]).alias("prefix"),
        )

    short = F.when(F.length(seq) <= MASK_LIMIT, seq).otherwise("")
    marks = [
        _marks(short, set(codes)).alias(f"t{i}") for i, codes in enumerate(("ATCG", "TG", "CG"))
    ]
    return let(F.struct(seq.alias("seq"), *marks), build)


def _pair_by_options(v: Column, move: Callable[[Column], Column]) -> Column:
    pairs = None
    for i in range(4):
        both = v[f"l{i}"].bitwiseAND(move(v[f"s{i}"]))
        pairs = both if pairs is None else pairs.bitwiseOR(both)
    return pairs


def _pair_by_identity(v: Column, move: Callable[[Column], Column]) -> Column:
    differ = v["l1"].bitwiseXOR(move(v["s1"])).bitwiseOR(v["l2"].bitwiseXOR(move(v["s2"])))
    return v["l0"].bitwiseAND(move(v["s0"])).bitwiseAND(F.bitwise_not(differ))


def _shift_bounds(m: Column, n: Column, f_skip: Column, r_skip: Column) -> tuple[Column, Column]:
    """Shifts s with long[i + s] over short[i]: overhangs keep at least two bases."""
    head = f_skip <= n - 2
    tail = r_skip <= n - 2
    low = F.when(head, 2 - n + f_skip).otherwise(F.lit(0))
    inner = m - n - 1
    high = F.when(tail, m - 2 - r_skip).when(head, F.greatest(F.lit(0), inner)).otherwise(inner)
    return low, high


def _shifted(first: Column, last: Column, body: Callable[[Column], Column]) -> Column:
    """body(shift) for every shift in [first, last]; nothing if the range is empty."""
    return F.when(first <= last, F.transform(F.sequence(first, last), body)).otherwise(
        F.array().cast("array<bigint>")
    )


def _strand_masks(first: Column, second: Column, width: int, f_skip: Column, r_skip: Column) -> Column:
    """Longer oligo against the reverse complement of the shorter.

    Equal lengths keep the given order; swapping the oligos swaps the end exclusions.
    """
    swap = first["n"] < second["n"]
    m, n = F.greatest(first["n"], second["n"]), F.least(first["n"], second["n"])
    low, high = _shift_bounds(
        m,
        n,
        F.when(swap, r_skip).otherwise(f_skip).cast("int"),
        F.when(swap, f_skip).otherwise(r_skip).cast("int"),
    )
    return F.struct(
        *[
            F.when(swap, second[f"l{i}"]).otherwise(first[f"l{i}"]).alias(f"l{i}")
            for i in range(width)
        ],
        *[
            F.when(swap, first[f"s{i}"]).otherwise(second[f"s{i}"]).alias(f"s{i}")
            for i in range(width)
        ],
        (m - n).alias("slack"),
        low.alias("low"),
        high.alias("high"),
    )


def _slide(strands: Column, pair: Callable) -> Column:
    """One mask of paired positions (in bits of the longer oligo) per shift.

    Bits move up by (slack - shift): leftwards up to the slack, rightwards beyond it.
    """
    return let(
        strands,
        lambda v: F.concat(
            _shifted(
                F.greatest(v["slack"] - v["high"], F.lit(0)),
                v["slack"] - v["low"],
                lambda o: pair(v, lambda x: _shl(x, o)),
            ),
            _shifted(
                F.greatest(v["low"] - v["slack"], F.lit(1)),
                v["high"] - v["slack"],
                lambda o: pair(v, lambda x: _shr(x, o)),
            ),
        ),
    )


def _longest_run(masks: Column, limit: Column) -> Column:
    """Longest run of set bits in any mask: erode until nothing is left."""

    def alive(values: Column) -> Column:
        return F.filter(values, lambda x: x != 0)

    def erode(state: Column, _: Column) -> Column:
        return F.struct(
            alive(F.transform(state["m"], lambda x: x.bitwiseAND(_shr(x, F.lit(1))))).alias("m"),
            (state["run"] + F.when(F.size(state["m"]) > 0, 1).otherwise(0)).alias("run"),
        )

    start = F.struct(alive(masks).alias("m"), F.lit(0).alias("run"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(limit, F.lit(1))), start, erode, lambda s: s["run"])


# --- sequences of any length: arrays of option sets -------------------------------


def _option_sets(seq: Column) -> Column:
    """Per position a 4-bit set of possible bases."""
    hexes = "".join(
        format(sum(1 << i for i, base in enumerate(C.BASES) if base in options), "x")
        for options in C.IUPAC_OPTIONS.values()
    ) + "0"
    return F.transform(
        F.split(F.translate(seq, _CODES, hexes), ""), lambda c: F.conv(c, 16, 10).cast("int")
    )


def _match_strings(first: Column, second: Column, f_skip: Column, r_skip: Column) -> Column:
    """Per shift the overlap as a string of 1 (paired) and 0."""
    swap = F.length(first) < F.length(second)
    strands = F.struct(
        F.when(swap, second).otherwise(first).alias("long"),
        reverse_complement(F.when(swap, first).otherwise(second)).alias("short"),
        F.when(swap, r_skip).otherwise(f_skip).cast("int").alias("f_skip"),
        F.when(swap, f_skip).otherwise(r_skip).cast("int").alias("r_skip"),
    )

    def with_sets(parts: Column) -> Column:
        m, n = F.length(parts["long"]), F.length(parts["short"])
        bound = F.struct(
            _option_sets(parts["long"]).alias("l"),
            _option_sets(parts["short"]).alias("s"),
            m.alias("m"),
            n.alias("n"),
            F.struct(*_shift_bounds(m, n, parts["f_skip"], parts["r_skip"])).alias("range"),
        )

        def per_shift(v: Column) -> Column:
            def overlap(s: Column) -> Column:
                start_l = F.greatest(s, F.lit(0))
                start_s = F.greatest(-s, F.lit(0))
                size = F.least(v["m"] - start_l, v["n"] - start_s)
                return F.array_join(
                    F.zip_with(
                        F.slice(v["l"], start_l + 1, size),
                        F.slice(v["s"], start_s + 1, size),
                        lambda x, y: F.when(x.bitwiseAND(y) != 0, "1").otherwise("0"),
                    ),
                    "",
                )

            first, last = v["range"]["col1"], v["range"]["col2"]
            return F.when(
                first <= last, F.transform(F.sequence(first, last), overlap)
            ).otherwise(F.array().cast("array<string>"))

        return let(bound, per_shift)

    return let(strands, with_sets)


def _run_of_strings(strings: Column) -> Column:
    return F.array_max(
        F.transform(
            strings, lambda s: F.array_max(F.transform(F.split(s, "0"), lambda p: F.length(p)))
        )
    )


def _ones(marks: Column) -> Column:
    return F.length(F.replace(marks, F.lit("0"), F.lit("")))


def overlap_scores(first, second, f_skip=None, r_skip=None) -> Column:
    """``run`` and ``total`` of two encoded oligos (see encode_overlap).

    total: most complementary bases over every alignment; run: longest stretch of them.
    """
    first, second = _col(first), _col(second)
    f_skip, r_skip = _int(f_skip), _int(r_skip)

    def by_masks(masks: Column) -> Column:
        return F.struct(
            _longest_run(masks, F.lit(MASK_LIMIT)).alias("run"),
            F.coalesce(F.array_max(F.transform(masks, _popcount)), F.lit(0)).alias("total"),
        )

    def by_strings(strings: Column) -> Column:
        return F.struct(
            F.coalesce(_run_of_strings(strings), F.lit(0)).alias("run"),
            F.coalesce(F.array_max(F.transform(strings, _ones)), F.lit(0)).alias("total"),
        )

    short = let(_slide(_strand_masks(first, second, 4, f_skip, r_skip), _pair_by_options), by_masks)
    long = let(_match_strings(first["seq"], second["seq"], f_skip, r_skip), by_strings)
    return F.when(F.greatest(first["n"], second["n"]) <= MASK_LIMIT, short).otherwise(long)


def _encoded(first, second, score: Callable[[Column, Column], Column], encode: Callable) -> Column:
    both = F.struct(encode(first).alias("a"), encode(second).alias("b"))
    return let(both, lambda v: score(v["a"], v["b"]))


def max_overlap_total(first, second, f_skip=None, r_skip=None) -> Column:
    """Most complementary bases over every alignment of two 5'-3' oligos."""
    return _encoded(
        first, second, lambda a, b: overlap_scores(a, b, f_skip, r_skip)["total"], encode_overlap
    )


def max_overlap_run(first, second, f_skip=None, r_skip=None) -> Column:
    """Longest stretch of complementary bases over every alignment."""
    return _encoded(
        first, second, lambda a, b: overlap_scores(a, b, f_skip, r_skip)["run"], encode_overlap
    )


def _int(value) -> Column:
    if value is None:
        return F.lit(0)
    if isinstance(value, int):
        return F.lit(value)
    return _col(value)


def overlap_dimer_encoded(first, second) -> Column:
    """Weighted run and total overlap of encoded oligos, relative to the summed lengths."""
    first, second = _col(first), _col(second)
    size = first["n"] + second["n"]
    return let(
        overlap_scores(first, second),
        lambda v: F.when(
            size > 0,
            C.OVERLAP_SCALE * (v["run"] * C.RUN_WEIGHT + v["total"] * C.TOTAL_WEIGHT) / size,
        ),
    )


def overlap_dimer_score(first, second) -> Column:
    return _encoded(first, second, overlap_dimer_encoded, encode_overlap)


def quad_dimer_score(f_adapter, f_binding, r_adapter, r_binding) -> Column:
    """Root of the summed squares of the four adapter/binding overlap scores, over four."""
    oligos = F.array(_col(f_adapter), _col(f_binding), _col(r_adapter), _col(r_binding))

    def pairings(v: Column) -> Column:
        chosen = [(0, 3), (1, 3), (1, 2), (0, 2)]
        return F.array(
            *[F.struct(F.get(v, F.lit(i)).alias("a"), F.get(v, F.lit(j)).alias("b")) for i, j in chosen]
        )

    scores = F.transform(
        let(F.transform(oligos, encode_overlap), pairings),
        lambda p: overlap_dimer_encoded(p["a"], p["b"]),
    )
    return F.sqrt(F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x * x)) / 4


def region_penalty(mean_conservation, dimer_score) -> Column:
    return F.pow(100 - _col(mean_conservation), F.lit(C.CONSERVATION_EXPONENT)) * F.pow(
        _col(dimer_score), F.lit(C.DIMER_EXPONENT)
    )


# --- complementarity at one site --------------------------------------------------


def _site_string(oligo: Column, seq: Column, offset: Column) -> Column:
    sets = F.struct(
        _option_sets(complement(oligo)).alias("o"),
        _option_sets(F.substring(seq, offset + 1, F.length(oligo))).alias("s"),
    )
    return let(
        sets,
        lambda v: F.array_join(
            F.zip_with(
                v["o"], v["s"], lambda x, y: F.when(x.bitwiseAND(y) != 0, "1").otherwise("0")
            ),
            "",
        ),
    )


def site_complementarity(oligo, seq, offset) -> Column:
    """Complementary bases of an oligo laid on a sequence at one offset."""
    matches = _site_string(_col(oligo), _col(seq), _col(offset))
    return F.length(F.replace(matches, F.lit("0"), F.lit("")))


def site_complementarity_run(oligo, seq, offset) -> Column:
    matches = _site_string(_col(oligo), _col(seq), _col(offset))
    return F.array_max(F.transform(F.split(matches, "0"), lambda p: F.length(p)))


def contained_scores(oligo, seq) -> Column:
    """``run`` and ``total`` with the shorter encoded oligo fully inside the longer.

    The shorter is complemented in place: both run in the direction given. The last
    offset is not compared, so equal lengths give 0.
    """
    oligo, seq = _col(oligo), _col(seq)
    swap = seq["n"] < oligo["n"]
    partner = {0: 1, 1: 0, 2: 3, 3: 2}

    def strands() -> Column:
        return F.struct(
            *[F.when(swap, oligo[f"l{i}"]).otherwise(seq[f"l{i}"]).alias(f"l{i}") for i in range(4)],
            *[
                F.when(swap, seq[f"l{partner[i]}"]).otherwise(oligo[f"l{partner[i]}"]).alias(f"s{i}")
                for i in range(4)
            ],
            F.abs(seq["n"] - oligo["n"]).alias("slack"),
        )

    def slide(v: Column) -> Column:
        return _shifted(F.lit(1), v["slack"], lambda o: _pair_by_options(v, lambda x: _shl(x, o)))

    def by_masks(masks: Column) -> Column:
        return F.struct(
            _longest_run(masks, F.lit(MASK_LIMIT)).alias("run"),
            F.coalesce(F.array_max(F.transform(masks, _popcount)), F.lit(0)).alias("total"),
        )

    def by_strings(strings: Column) -> Column:
        return F.struct(
            F.coalesce(_run_of_strings(strings), F.lit(0)).alias("run"),
            F.coalesce(F.array_max(F.transform(strings, _ones)), F.lit(0)).alias("total"),
        )

    short = let(let(strands(), slide), by_masks)
    long = let(_contained_strings(oligo["seq"], seq["seq"]), by_strings)
    return F.when(F.greatest(oligo["n"], seq["n"]) <= MASK_LIMIT, short).otherwise(long)


def _contained_strings(oligo: Column, seq: Column) -> Column:
    swap = F.length(seq) < F.length(oligo)
    strands = F.struct(
        _option_sets(F.when(swap, oligo).otherwise(seq)).alias("l"),
        _option_sets(complement(F.when(swap, seq).otherwise(oligo))).alias("s"),
        F.least(F.length(seq), F.length(oligo)).alias("n"),
        F.abs(F.length(seq) - F.length(oligo)).alias("slack"),
    )

    def per_offset(v: Column) -> Column:
        offsets = F.when(v["slack"] > 0, F.sequence(F.lit(0), v["slack"] - 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            offsets,
            lambda o: F.array_join(
                F.zip_with(
                    F.slice(v["l"], o + 1, v["n"]),
                    v["s"],
                    lambda x, y: F.when(x.bitwiseAND(y) != 0, "1").otherwise("0"),
                ),
                "",
            ),
        )

    return let(strands, per_offset)


def max_contained_complementarity(oligo, seq) -> Column:
    """Most complementary bases with the shorter fully inside the longer."""
    return _encoded(oligo, seq, lambda a, b: contained_scores(a, b)["total"], encode_overlap)


def max_contained_run(oligo, seq) -> Column:
    return _encoded(oligo, seq, lambda a, b: contained_scores(a, b)["run"], encode_overlap)


# --- thermodynamics ---------------------------------------------------------------


def _steps_by_masks(seq: Column) -> Column:
    """How often each of the 16 dinucleotide steps occurs, in order of C.BASES."""
    masks = F.struct(*[_bits(_marks(seq, {b})).alias(f"m{i}") for i, b in enumerate(C.BASES)])
    return let(
        masks,
        lambda v: F.array(
            *[
                _popcount(_shr(v[f"m{i}"], F.lit(1)).bitwiseAND(v[f"m{j}"]))
                for i in range(4)
                for j in range(4)
            ]
        ),
    )


def _steps_by_walking(seq: Column) -> Column:
    """The same for a sequence of any length."""
    pieces = F.transform(
        F.sequence(F.lit(1), F.length(seq) - 1), lambda i: F.substring(seq, i, F.lit(2))
    )
    names = F.array(*[F.lit(a + b) for a in C.BASES for b in C.BASES])
    return let(
        pieces,
        lambda p: F.transform(names, lambda name: F.size(F.filter(p, lambda x: x == name))),
    )


def melting_temperature(seq, sodium: float = C.SODIUM_MOLAR, oligo: float = C.OLIGO_MOLAR) -> Column:
    """Nearest-neighbour melting temperature in Celsius of a plain sequence.

    Steps are counted, not walked, so the sums are exact integers. NULL for sequences
    with anything but A, T, C, G, or shorter than two bases. Values are bound to
    variables to keep the expression small: planning time grows with its size.
    """
    seq = _col(seq)
    table = C.step_table()

    def parameter(index: int) -> Column:
        return F.array(*[F.lit(table[a + b][index]) for a in C.BASES for b in C.BASES])

    def scored(v: Column) -> Column:
        def total(index: int) -> Column:
            products = F.zip_with(v["steps"], parameter(index), lambda n, x: n * x)
            return F.aggregate(products, F.lit(0), lambda acc, x: acc + x)

        strong = F.length(F.regexp_replace(F.concat(F.left(v["seq"], F.lit(1)), F.right(v["seq"], F.lit(1))), "[AT]", ""))
        enthalpy = total(0) + strong * C.TERMINAL_GC[0] + (2 - strong) * C.TERMINAL_AT[0]
        entropy = (
            total(1) + strong * C.TERMINAL_GC[1] + (2 - strong) * C.TERMINAL_AT[1]
            + F.when(v["seq"] == reverse_complement(v["seq"]), C.SYMMETRY_ENTROPY).otherwise(0)
        )
        salted = entropy / 10.0 + C.SALT_COEFFICIENT * (F.length(v["seq"]) - 1) * F.ln(F.lit(sodium))
        return enthalpy * 100.0 / (salted + C.GAS_CONSTANT * F.ln(F.lit(oligo / 4))) - C.KELVIN

    def counted(s: Column) -> Column:
        steps = F.when(F.length(s) <= MASK_LIMIT, _steps_by_masks(s)).otherwise(_steps_by_walking(s))
        valid = (F.length(s) >= 2) & ~s.rlike("[^ATCG]")
        return F.when(valid, let(F.struct(s.alias("seq"), steps.alias("steps")), scored))

    return let(seq, counted)


def _energy_prefix(seq: Column) -> Column:
    """Running stack energy along a sequence, in 0.01 kcal/mol; unknown steps are 0."""
    table = C.step_table()
    pairs = []
    for step in sorted(table):
        pairs += [F.lit(step), F.lit(table[step][2])]

    def with_map(energies: Column) -> Column:
        def grow(state: Column, i: Column) -> Column:
            step = F.coalesce(
                F.try_element_at(energies, F.substring(seq, i, F.lit(2))), F.lit(0)
            )
            return F.concat(state, F.array(F.element_at(state, -1) + step))

        return F.when(
            F.length(seq) >= 2,
            F.aggregate(F.sequence(F.lit(1), F.length(seq) - 1), F.array(F.lit(0)), grow),
        ).otherwise(F.array(F.lit(0)))

    return let(F.create_map(*pairs), with_map)


def _lowest_run_energy(stacks: Column, prefix: Column, size: Column) -> Column:
    """Lowest energy of one run of stacked pairs over a list of stack masks.

    A set bit marks the second pair of a stack. Runs are peeled off one by one from the
    low end: adding the lowest bit carries through the run and clears it.
    """

    def best_of_mask(mask: Column) -> Column:
        starts = _popcount(mask.bitwiseAND(_shl(mask, F.lit(1)).bitwiseXOR(F.lit(-1).cast("bigint"))))

        def peel(state: Column, _: Column) -> Column:
            def with_low(low: Column) -> Column:
                rest = state["rest"].bitwiseAND(state["rest"] + low)
                first = _popcount(low - 1)
                length = _popcount(state["rest"].bitwiseXOR(rest))
                top = size - 1 - first
                energy = F.get(prefix, top) - F.get(prefix, top - length)
                return F.struct(rest.alias("rest"), F.least(state["best"], energy).alias("best"))

            return let(state["rest"].bitwiseAND(-state["rest"]), with_low)

        return F.aggregate(
            F.sequence(F.lit(1), starts),
            F.struct(mask.alias("rest"), F.lit(0).alias("best")),
            peel,
            lambda s: s["best"],
        )

    return F.coalesce(F.array_min(F.transform(stacks, best_of_mask)), F.lit(0))


def _stacks(masks: Column) -> Column:
    return F.filter(
        F.transform(masks, lambda x: x.bitwiseAND(_shr(x, F.lit(1)))), lambda x: x != 0
    )


def dimer_energy_encoded(first, second) -> Column:
    """Energy (kcal/mol) of the most stable ungapped duplex of two encoded oligos.

    A duplex is one run of paired bases, its energy the sum of its nearest-neighbour
    stacks; 0.0 where no two adjacent bases pair.
    """
    first, second = _col(first), _col(second)
    fits = F.greatest(first["n"], second["n"]) <= MASK_LIMIT
    return F.when(fits, _mask_energy(first, second)).otherwise(_base_energy(first, second)) / 100.0


def _mask_energy(first: Column, second: Column) -> Column:
    strands = _strand_masks(first, second, 3, F.lit(0), F.lit(0))
    bound = F.struct(
        _stacks(_slide(strands, _pair_by_identity)).alias("stacks"),
        F.when(first["n"] < second["n"], second["prefix"]).otherwise(first["prefix"]).alias("prefix"),
        F.greatest(first["n"], second["n"]).alias("size"),
    )
    return let(bound, lambda v: _lowest_run_energy(v["stacks"], v["prefix"], v["size"]))


def _walked_energy(first: Column, last: Column, paired: Callable[[Column], Column], prefix: Column) -> Column:
    """Lowest energy of a run of paired positions from first to last; every stack lowers a run's energy."""

    def step(state: Column, i: Column) -> Column:
        def with_pair(now: Column) -> Column:
            energy = F.when(now & state["on"], state["run"] + F.get(prefix, i) - F.get(prefix, i - 1)).otherwise(0)
            return let(
                energy,
                lambda e: F.struct(e.alias("run"), F.least(state["best"], e).alias("best"), now.alias("on")),
            )

        return let(paired(i), with_pair)

    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(False).alias("on"))
    return F.when(
        first <= last, F.aggregate(F.sequence(first, last), start, step, lambda s: s["best"])
    ).otherwise(F.lit(0))


def _pairing_bases(seq: Column) -> Column:
    """The base that pairs with each; degenerate and other signs pair with nothing."""
    return F.translate(F.regexp_replace(seq, "[^ATCG]", "."), "ATCG", "TAGC")


def _base_energy(first: Column, second: Column) -> Column:
    """The same as the masks give, base by base, for oligos of any length.

    All shifts at once: along the longer oligo, one value for each base of the shorter, the energy
    of the run of pairs that ends there, or 1 where the two bases do not pair.
    """
    swap = first["n"] < second["n"]
    strands = F.struct(
        F.when(swap, second["seq"]).otherwise(first["seq"]).alias("l"),
        F.split(F.reverse(_pairing_bases(F.when(swap, first["seq"]).otherwise(second["seq"]))), "").alias("s"),
        F.when(swap, second["prefix"]).otherwise(first["prefix"]).alias("prefix"),
        F.greatest(first["n"], second["n"]).alias("m"),
        F.least(first["n"], second["n"]).alias("n"),
    )

    def along(v: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            here = F.struct(
                F.substring(v["l"], i + 1, F.lit(1)).alias("base"),
                (F.get(v["prefix"], i) - F.get(v["prefix"], i - 1)).alias("stack"),
                F.concat(F.array(F.lit(1)), F.slice(state["runs"], F.lit(1), F.greatest(v["n"] - 1, F.lit(0)))).alias("before"),
            )

            def ending(h: Column) -> Column:
                return F.zip_with(
                    h["before"], v["s"], lambda run, base: F.when(base == h["base"], F.when(run <= 0, run + h["stack"]).otherwise(0)).otherwise(1)
                )

            return let(let(here, ending), lambda runs: F.struct(runs.alias("runs"), F.least(state["best"], F.array_min(runs)).alias("best")))

        start = F.struct(F.array_repeat(F.lit(1), v["n"]).alias("runs"), F.lit(0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), v["m"] - 1), start, step, lambda s: s["best"])

    return let(strands, along)


def dimer_energy(first, second) -> Column:
    """Energy of two 5'-3' oligos of any length.

    ``trim_to_solver_limit`` is there for who wants the bound of an outside solver.
    """
    return _encoded(first, second, dimer_energy_encoded, encode_energy)


def homodimer_energy(seq) -> Column:
    return let(encode_energy(seq), lambda v: dimer_energy_encoded(v, v))


def hairpin_energy_encoded(oligo) -> Column:
    """Energy of the best stem an encoded oligo folds into, loops of three or more."""
    v = _col(oligo)
    return F.when(v["n"] <= MASK_LIMIT, _mask_hairpin(v)).otherwise(_base_hairpin(v)) / 100.0


def _base_hairpin(v: Column) -> Column:
    """The same as the masks give, base by base: base i pairs with base turn - i."""

    def folded(s: Column) -> Column:
        def at_turn(turn: Column) -> Column:
            def paired(i: Column) -> Column:
                return F.substring(s["l"], i + 1, F.lit(1)) == F.substring(s["p"], turn - i + 1, F.lit(1))

            last = F.floor((turn - 1 - C.MIN_LOOP) / 2).cast("int")
            return _walked_energy(F.greatest(F.lit(0), turn - s["n"] + 1), last, paired, s["prefix"])

        return F.least(F.coalesce(F.array_min(F.transform(F.sequence(F.lit(1), 2 * s["n"] - 3), at_turn)), F.lit(0)), F.lit(0))

    strands = F.struct(v["seq"].alias("l"), _pairing_bases(v["seq"]).alias("p"), v["prefix"].alias("prefix"), v["n"].alias("n"))
    return let(strands, folded)


def _mask_hairpin(v: Column) -> Column:

    def five_prime_arm(pairs: Column, shift: Column) -> Column:
        # Base i pairs with base shift + size - 1 - i: keep the arm before the loop.
        last = F.floor((shift + v["n"] - 2 - C.MIN_LOOP) / 2).cast("int")
        return pairs.bitwiseAND(_shl(F.lit(-1).cast("bigint"), v["n"] - 1 - last))

    def left(o: Column) -> Column:
        return five_prime_arm(_pair_by_identity(v, lambda x: _shl(x, o)), -o)

    def right(o: Column) -> Column:
        return five_prime_arm(_pair_by_identity(v, lambda x: _shr(x, o)), o)

    # A stem of two pairs around the smallest loop needs 2 + 2 + loop bases.
    furthest = v["n"] - 4 - C.MIN_LOOP
    stems = F.concat(_shifted(F.lit(0), furthest, left), _shifted(F.lit(1), furthest, right))
    return let(_stacks(stems), lambda x: _lowest_run_energy(x, v["prefix"], v["n"]))


def hairpin_energy(seq) -> Column:
    return let(encode_energy(seq), hairpin_energy_encoded)


def energy_as_int(energy: Column | str) -> Column:
    """Whole, sign-flipped form: truncated toward zero."""
    return -_col(energy).cast("bigint")


# --- IUPAC base pairs -------------------------------------------------------------


def _options(base: Column) -> Column:
    sets = "".join(
        format(sum(1 << i for i, b in enumerate(C.BASES) if b in options), "x")
        for options in C.IUPAC_OPTIONS.values()
    )
    return F.conv(F.translate(base, "".join(C.IUPAC_OPTIONS), sets), 16, 10).cast("int")


def iupac_match_probability(first, second) -> Column:
    """Share of option combinations in which two codes are the same base."""
    a, b = _options(_col(first)), _options(_col(second))
    combos = _popcount(a) * _popcount(b)
    return F.when(combos > 0, _popcount(a.bitwiseAND(b)) / combos).otherwise(F.lit(0.0))


def iupac_compatible(first, second) -> Column:
    """Equal codes, or option sets that share a base."""
    first, second = _col(first), _col(second)
    return (first == second) | (_options(first).bitwiseAND(_options(second)) != 0)


def same_base_unless_ignored(first, second) -> Column:
    first, second = _col(first), _col(second)
    return (first == second) & (first != "I") & (second != "I")
