"""N-gram Jaccard join: documents whose sets of word shingles have a similarity of 0.75 or more.

Three steps, each exact:

1. Coverage. Of each set the shingles of least hash are looked at: as many as may be
   missing in a similar set, and a share more. By the prefix principle two similar sets
   have at least that share in common there, so a set stays only if so many of these
   shingles stand in another set too. A batch of documents reports a shingle once, however
   many of its sets hold it.
2. Order. The sets that stay are ordered by the frequency of their shingles, the rarest
   first. Two similar sets share a shingle of their prefixes. Each set is compared with
   the set it meets most often there, and what links is one component from then on.
3. Prefix trees. Only sets of different components that share a prefix shingle are left,
   and of these only such as have enough shingles of other components. The smaller of two
   similar sets has more in common with the larger than its own size alone tells the other
   way, so its prefix is shorter; sets meet on a shingle and a class of sizes where one of
   them has it in this shorter prefix. What meets, directly or by way of others, is a piece.
   The sets of a piece, or of a shingle and class if the piece is large, are kept as a trie
   of ordered shingles and traversed: overlaps of a common path are counted once, and a
   subtree is left as soon as too few shingles remain. The first link found joins two
   components, so copies are never expanded into pairs, nor are components.

Sets are compared by 64-bit hashes of their shingles.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oligoweave.llm.common import free_names, rows_of, text_or_empty
from oligoweave.llm.graph import components
from oligoweave.llm.shingles import WORDS, Shingler, sets_of, spread
from oligoweave.session import cut_lineage

#: Similarity as a fraction of whole numbers.
NUMERATOR, DENOMINATOR = 3, 4
#: Share of a set, in twentieths, that the coverage step wants to see again.
EXTRA = 3
#: Times that sets without a possible link to another component are put aside.
REFINED = 2
#: Sets that a trie has from one part of a group at most; larger groups are dealt into parts, and each two of these meet.
SIDE = 512
#: Parts of a piece at most; what is larger is taken by shingle and class of sizes.
PARTS = 16


def least_overlap(n):
    """Shingles that a set of n has at least in common with a similar one (numbers, arrays or columns)."""
    return -(-n * NUMERATOR // DENOMINATOR)


def extra(n):
    return -(-n * EXTRA // 20)


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            _, sizes, keys = sets_of(batch.column("text"), shingler)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64))],
                ["doc_id", "n_shingles", "set_id", "check"],
            )

    return run


def _prefixes(words: int):
    """Rows of one batch: each shingle once, with its set or none if several sets of the batch hold it, and what each set still needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            values, sizes, keys = sets_of(batch.column("text"), shingler)
            starts = np.cumsum(sizes) - sizes
            ids, first = np.unique(keys[:, 0][sizes > 0], return_index=True)
            docs = np.flatnonzero(sizes > 0)[first]
            starts, n = starts[docs], sizes[docs]
            long = n - least_overlap(n) + extra(n)
            at = np.repeat(starts - (np.cumsum(long) - long), long) + np.arange(long.sum())
            token, owner = values[at], np.repeat(np.arange(len(docs)), long)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            run_of = np.cumsum(new) - 1
            several = np.bincount(run_of, minlength=0)[run_of] > 1 if len(token) else np.zeros(0, bool)
            seen = np.bincount(owner[several], minlength=len(docs))
            needs = extra(least_overlap(n)) - seen
            single = new & ~several
            mark = np.bitwise_xor.reduce(ids) if len(ids) else np.uint64(0)
            parts = [
                (token[single], ids[owner[single]], None),
                (token[new & several], None, None),
                (spread(ids ^ np.uint64(0x0F0F)), ids, needs),
            ]
            for tokens, sets, short in parts:
                m = len(tokens)
                for a in range(0, m, 100_000):
                    z = slice(a, a + 100_000)
                    k = len(tokens[z])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(tokens[z].view(np.int64)),
                            pa.nulls(k, pa.int64()) if sets is None else pa.array(sets[z].view(np.int64)),
                            pa.array(np.full(k, mark).view(np.int64)),
                            pa.nulls(k, pa.int32()) if short is None else pa.array(short[z].astype(np.int32)),
                        ],
                        ["token", "set_id", "batch", "needs"],
                    )

    return run


def covered_sets(rows: DataFrame, words: int) -> DataFrame:
    """set_id of the sets that may have a similar one: rows are (text)."""
    found = rows.select("text").mapInArrow(_prefixes(words), "token long, set_id long, batch long, needs int")
    same = Window.partitionBy("token")
    shared = (F.min("set_id").over(same) != F.max("set_id").over(same)) | (F.count("set_id").over(same) < F.count("*").over(same))
    marked = found.withColumn("shared", F.coalesce(shared, F.lit(False))).where(F.col("set_id").isNotNull() & (F.col("shared") | F.col("needs").isNotNull()))
    by_set = marked.groupBy("set_id", "batch").agg(F.count_if(F.col("needs").isNull()).alias("seen"), F.max("needs").alias("needs"))
    return by_set.where("seen >= needs").select("set_id").distinct()


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            values, sizes, keys = sets_of(batch.column("text"), shingler)
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[:, 0].view(np.int64)), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))],
                ["set_id", "n", "tokens"],
            )

    return run


def _similar(left: Column, right: Column, n: Column, m: Column) -> Column:
    common = F.size(F.array_intersect(left, right))
    return common * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (n + m)


def _ordered(sets: DataFrame) -> DataFrame:
    """set_id, n, tokens (those that other sets have too, rarest first), in_prefix: how many of these are in the prefix."""
    each = sets.select("set_id", "n", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    ranked = each.join(often, "token").groupBy("set_id", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("ranked"))
    prefix = F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1 - (F.col("n") - F.size("ranked"))
    return ranked.select("set_id", "n", F.col("ranked.token").alias("tokens"), prefix.cast("int").alias("in_prefix")).where("in_prefix > 0")


def _stars(prefixes: DataFrame, sets: DataFrame, order: Column) -> DataFrame:
    """Links (a, b) of each set with one other: of the first sets by `order` of its prefix shingles, that of another component which it meets most often.

    prefixes: token, set_id, n, component, and what `order` needs.
    """
    first = F.struct(order.alias("order"), "set_id", "component")
    heads = prefixes.groupBy("token").agg(F.min(first).alias("first")).select(
        "token", F.col("first.set_id").alias("head"), F.col("first.component").alias("head_component")
    )
    met = prefixes.join(heads, "token").where("head_component <> component").groupBy("set_id", "head").agg(F.count("*").alias("times"))
    best = met.groupBy("set_id").agg(F.max_by("head", F.struct("times", "head")).alias("head"))
    own = sets.select("set_id", "n", "tokens")
    other = sets.select(F.col("set_id").alias("head"), F.col("n").alias("m"), F.col("tokens").alias("with"))
    return best.join(own, "set_id").join(other, "head").where(_similar(F.col("tokens"), F.col("with"), F.col("n"), F.col("m"))).select(
        F.col("head").alias("a"), F.col("set_id").alias("b")
    )


def trie_links(sets: list[tuple[int, np.ndarray, int, int]], apart: bool = False) -> list[tuple[int, int]]:
    """Similar pairs (positions) that connect the components of these sets: (size, ordered shingles, component, part).

    Sorted, the sets are the leaves of a trie in order, and neighbours share the path of
    their common beginning. For each set the leaves after it are traversed: `missing` holds,
    for each place of the path, how many shingles up to there are not in the set, so a
    common path is counted once; where more are missing than the length that remains can
    make up for, all leaves below that place are passed over. Sets of one component are not
    compared, nor, if `apart`, sets of one part.
    """
    paths = sorted(((s.tolist(), n, c, part, j) for j, (n, s, c, part) in enumerate(sets)), key=lambda x: x[0])
    common = [0]
    for (a, *_), (b, *_) in zip(paths, paths[1:], strict=False):
        depth = 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            depth += 1
        common.append(depth)
    parent = {x[2]: x[2] for x in paths}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    scale, links = NUMERATOR + DENOMINATOR, []
    for i, (own, n, component, part, left) in enumerate(paths):
        inside, missing, here = set(own), [0] * (len(own) + 1), root(component)
        for (path, m, other, other_part, right), shared in zip(paths[i + 1 :], common[i + 1 :], strict=True):
            if shared < len(missing) - 1:
                del missing[shared + 1 :]
            wanted = -(-NUMERATOR * (n + m) // scale)
            allowed = len(path) - wanted
            count = missing[-1]
            if count > allowed or len(own) < wanted or (apart and part == other_part) or root(other) == here:
                continue
            for t in path[len(missing) - 1 :]:
                count += t not in inside
                missing.append(count)
                if count > allowed:
                    break
            if count <= allowed:
                links.append((left, right))
                parent[root(other)] = here
    return links


def _tree_joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks (unit, class, p0, p1; part, set_id, n, component, tokens), sorted by block: links between their components."""
    key, ids, sets = None, [], []
    links: tuple[list, list] = ([], [])

    def close() -> None:
        for i, j in trie_links(sets, apart=key[2] != key[3]):
            links[0].append(ids[i])
            links[1].append(ids[j])

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        part, set_id, n, component = (batch.column(i).to_pylist() for i in range(4, 8))
        tokens = batch.column(8)
        values, offsets = tokens.flatten().to_numpy(), (tokens.offsets.to_numpy() - tokens.offsets[0].as_py()).tolist()
        for row, own in enumerate(keys):
            if own != key:
                if key is not None:
                    close()
                key, ids, sets = own, [], []
            ids.append(set_id[row])
            sets.append((n[row], values[offsets[row] : offsets[row + 1]].copy(), component[row], part[row]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])
        links[0].clear()
        links[1].clear()
    if key is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])


def _size_class(n: Column) -> Column:
    """Similar sets are of one class of sizes or of two next to each other."""
    return F.floor(F.log(n) / math.log(DENOMINATOR / NUMERATOR)).cast("int")


def _meeting(prefixes: DataFrame) -> DataFrame:
    """token, class, set_id, component: where a set may meet a similar one of another component.

    prefixes: token, set_id, n, component, small (whether the shingle is in the shorter
    prefix that a set has as the smaller of two). A set is in its class, and as the larger
    of two in that of the sizes it allows. Each class of a shingle has a smaller set, and
    sets of several components.
    """
    least = F.ceil(F.col("n") * NUMERATOR / DENOMINATOR)
    each = prefixes.withColumn("own", _size_class(F.col("n"))).select(
        "token", "set_id", "component", "small", "own", F.explode(F.sequence(_size_class(least), F.col("own"))).alias("class")
    )
    live = each.groupBy("token", "class").agg(
        F.bool_or(F.col("small") & (F.col("class") == F.col("own"))).alias("smaller"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    return each.join(live.where("smaller and lo <> hi").select("token", "class"), ["token", "class"]).select("token", "class", "set_id", "component")


def _across(groups: DataFrame, ordered: DataFrame) -> DataFrame:
    """Links (a, b) that connect components; groups: token, class, set_id, component of sets that may meet.

    The sets that hang together by these groups are a piece, and taken at once if they are
    PARTS * SIDE at most; else those of each group are. What is taken at once is one trie, or,
    beyond SIDE sets, one for each two of its parts. No two sets, nor two components, are a row.
    """
    heads = groups.groupBy("token", "class").agg(F.min("set_id").alias("a"))
    pieces = components(groups.join(heads, ["token", "class"]).select("a", F.col("set_id").alias("b")).distinct())
    small = pieces.groupBy("component").agg(F.count("*").alias("sets")).where(F.col("sets") <= PARTS * SIDE)
    placed = pieces.join(small, "component", "left").select(F.col("node").alias("set_id"), F.when(F.col("sets").isNotNull(), F.col("component")).alias("piece"))
    members = cut_lineage(
        groups.join(placed, "set_id")
        .select(F.coalesce("piece", "token").alias("unit"), F.when(F.col("piece").isNull(), F.col("class")).otherwise(-1).alias("class"), "set_id", "component")
        .distinct()
    )
    sizes = members.groupBy("unit", "class").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, "part").alias("p0"), F.greatest(i, "part").alias("p1")))
    block = ["unit", "class", "p0", "p1"]
    dealt = members.join(sizes, ["unit", "class"]).withColumn("part", part).select("unit", "class", "part", "set_id", "component", F.inline(others))
    full = dealt.join(ordered.select("set_id", "n", "tokens"), "set_id")
    full = full.select(*block, "part", "set_id", "n", "component", "tokens").repartition(*block).sortWithinPartitions(*block, "set_id")
    return full.mapInArrow(_tree_joins, "a long, b long")


def _placed(prefixes: DataFrame, links: DataFrame) -> DataFrame:
    """prefixes with the component that the links put each set into."""
    near = components(links)
    placed = prefixes.drop("component").join(near, prefixes["set_id"] == near["node"], "left")
    return cut_lineage(placed.withColumn("component", F.coalesce("component", "set_id")).drop("node"))


def _mixed(prefixes: DataFrame) -> DataFrame:
    """The rows of shingles that more than one component has."""
    several = prefixes.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    return prefixes.join(several, "token")


def _refined(ordered: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets that can still have a link to another component, ordered anew by how many components have a shingle, and their prefixes.

    Only shingles that another component has can be common to a link between components, so
    a set stays only if enough of its shingles are such. What a set has in common with a
    similar one of its size or more is a larger share of it, so `small` marks a shorter prefix.
    """
    members = prefixes.select("set_id", "component").distinct()
    each = ordered.join(members, "set_id").select("set_id", "n", "component", F.explode("tokens").alias("token"))
    held = each.groupBy("token", "component").agg(F.count("*").alias("sets")).groupBy("token").agg(F.count("*").alias("components"))
    ranked = each.join(held.where("components > 1"), "token").groupBy("set_id", "n", "component").agg(
        F.array_sort(F.collect_list(F.struct("components", "token"))).alias("ranked")
    )
    prefix = F.size("ranked") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1
    left = cut_lineage(
        ranked.select("set_id", "n", "component", F.col("ranked.token").alias("tokens"), prefix.cast("int").alias("in_prefix")).where("in_prefix > 0")
    )
    shorter = F.size("tokens") - F.ceil(F.col("n") * 2 * NUMERATOR / (NUMERATOR + DENOMINATOR)) + 1
    anew = left.select("set_id", "n", "component", shorter.alias("shorter"), F.posexplode(F.slice("tokens", F.lit(1), F.col("in_prefix"))).alias("at", "token"))
    marked = anew.select("set_id", "n", "component", "token", (F.col("at") < F.col("shorter")).alias("small"))
    return left.drop("component"), cut_lineage(_mixed(marked))


def _one_of_equal(prefixes: DataFrame) -> DataFrame:
    """Of shingles that the very same sets have in the same prefixes, such as those of a common line, one."""
    held = prefixes.groupBy("token").agg(
        F.count("*").alias("sets"), F.bit_xor(F.xxhash64(F.lit(1), "set_id", "small")).alias("mark1"), F.bit_xor(F.xxhash64(F.lit(2), "set_id", "small")).alias("mark2")
    )
    kept = held.groupBy("sets", "mark1", "mark2").agg(F.min("token").alias("token")).select("token")
    return cut_lineage(prefixes.join(kept, "token", "left_semi"))


def similar_components(sets: DataFrame) -> DataFrame:
    """set_id, component of the sets (set_id, n, tokens) that are linked to others, directly or by way of others.

    Sets are first compared with the one that has the least shingles of its own, which is
    what a group of copies was made from, then with any. What links that leaves are found
    between the components.
    """
    ordered = cut_lineage(_ordered(sets))
    alone = (F.col("n") - F.size("tokens")) / F.col("n")
    prefixes = cut_lineage(
        ordered.select(
            "set_id", "n", alone.alias("alone"), F.col("set_id").alias("component"), F.explode(F.slice("tokens", F.lit(1), F.col("in_prefix"))).alias("token")
        )
    )
    links = None
    for order in (F.col("alone"), F.xxhash64("set_id"), F.col("alone")):
        found = cut_lineage(_stars(prefixes, ordered, order))
        links = found if links is None else links.union(found)
        prefixes = cut_lineage(_mixed(_placed(prefixes, links)))
    meeting = prefixes
    for _ in range(REFINED):
        ordered, prefixes = _refined(ordered, meeting)
        meeting = cut_lineage(_meeting(_one_of_equal(prefixes)))
    across = cut_lineage(_across(meeting, ordered))
    return components(links.union(across)).select(F.col("node").alias("set_id"), "component")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Per row of `df`: doc_id, n_shingles, component_id (the least id reachable by links, itself included).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; null text, or
    text without words, has no shingles and no links, and is its own component. Equal
    sets are linked. Rows of one id are rows of their own, with the same id; a null id is
    never the least one, and a component of null ids alone has none. An empty table gives
    no rows.
    """
    rows = rows_of(df, doc_id=id_col, text=text_col).withColumn("text", text_or_empty())
    described = cut_lineage(rows.mapInArrow(_describe(words), "doc_id long, n_shingles long, set_id long, check long"))
    covered = covered_sets(rows, words)
    named = described.where("n_shingles > 0").join(covered, "set_id", "left_semi").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    wanted = cut_lineage(named)
    texts = rows.join(wanted.select(F.col("doc_id").alias("wanted")).distinct(), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    made = texts.select("text").mapInArrow(_sets(words), "set_id long, n long, tokens array<long>").where("n > 0")
    sets = cut_lineage(made.join(wanted.select("set_id"), "set_id", "left_semi").groupBy("set_id").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")))
    near = similar_components(sets)
    named = described.join(near, "set_id", "left").withColumn("group", F.coalesce("component", "set_id"))
    least = named.where("n_shingles > 0").groupBy("group").agg(F.min("doc_id").alias("least"))
    return named.join(least, "group", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of `df` whose document has the least id of its component; equal rows stay once.

    Rows with a null id cannot be named and stay.
    """
    near = near_duplicates(df, id_col, text_col, words)
    (name,) = free_names(df, "kept_id")
    kept = near.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    named = df.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col(name), "left_semi")
    return named.dropDuplicates([id_col, text_col]).unionByName(df.where(F.col(id_col).isNull()))
