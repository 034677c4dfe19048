"""Secret and personal-data spans against plain regular expressions, and the corpus-wide steps."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from oligoweave.llm import personal, secrets
from oligoweave.llm.spans import Covered

RNG = random.Random(4)


def noise(alphabet, n):
    return "".join(RNG.choice(alphabet) for _ in range(n))


def plain_secrets(text):
    out = []
    for nth, (kind, pattern, least, group) in enumerate(
        [
            ("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6, 2),
            ("access", r"AKIA[A-Z0-9]+", 20, 0),
            ("hex", r"[0-9a-f]+", 24, 0),
        ]
    ):
        out += [(m.start(), nth, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def plain_personal(text):
    def digits(x):
        return re.sub(r"[^0-9]", "", x)

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0]))


def test_secret_spans_equal_plain_patterns():
    pieces = ["token", "API_KEY", "apikey", "PassWord", "ſecret", "=", ": ", ' = "', "'", "AKIA", "ABCDEF0123456789", "deadbeef00", "x", "é", "\n", "f" * 23]
    for _ in range(4000):
        text = "".join(RNG.choice(pieces) for _ in range(RNG.randrange(30)))
        got = ",".join(f"{x[1]}:{x[2]}:{x[3]}" for x in secrets.base_spans(text))
        assert got == plain_secrets(text)


def test_personal_spans_equal_plain_patterns():
    for _ in range(4000):
        text = noise("ab@@..-+% 0123(4)5é\n", RNG.randrange(60)) + noise("0123456789 .-", RNG.randrange(60))
        got = ",".join(f"{x[1]}:{x[2]}:{x[3]}" for x in personal.base_spans(text))
        assert got == plain_personal(text)
    card = "4111 1111-1111 1111"
    assert ("card", 2, 2 + len(card)) in [x[1:] for x in personal.base_spans(f"x {card} y")]


def test_places_taken_up_like_one_by_one():
    rng = random.Random(4)
    for _ in range(200):
        taken = [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(8)))]
        covered = Covered(taken)
        for a in range(62):
            for b in range(a + 1, a + 6):
                assert covered.meets(a, b) == any(x < b and a < y for x, y in taken)


def test_context_words_are_whole():
    text = "a " + "b" * 300 + " name " + "c" * 200 + " 4711 " + "d" * 500 + " e"
    at = text.index("4711")
    assert personal.contexts(text, at, at + 4) == ["name " + "c" * 200 + " _", "c" * 200 + " _ " + "d" * 500]
    assert personal.contexts("4711", 0, 4) == [] and personal.words_before("x y", 3, 5) == ["x", "y"]


def test_many_values_in_one_text():
    """Time grows with the values, not with their square."""
    text = "password=aB3xY9kLmN2pQ7rS token: Zk8mQ2wE5rT9yU1iO4pA x +49 30 1234567 id 4711-0815-99 " * 20_000
    start = time.time()
    base = secrets.base_spans(text)
    secrets.loose_tokens(text, base)
    mine = personal.base_spans(text)
    personal.loose_values(text, mine)
    assert len(base) >= 20_000 and len(mine) >= 20_000 and time.time() - start < 20


def test_long_texts_stay_quick():
    for text in ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "token=" * 50_000, "0" * 300_000]:
        personal.base_spans(text)
        personal.loose_values(text, [])
        secrets.loose_tokens(text, secrets.base_spans(text))


def test_ownership_separates_examples_from_secrets(spark):
    copied, own = "q8ZpT1xV9kLm2Rw7Yb3Nc6", "Zk4tQ9sWm1Xv7Lp2Hd8Rj5"
    rows = [(i, f"key {copied} end", f"owner{i}", "x") for i in range(10)] + [(20, f"see {own} and token = '{own}'", "owner1", "x")]
    rows += [(21, None, None, None), (None, "password: hunter2hunter2", None, None), (22, "", "owner1", "x"), (22, "", "owner1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, live_doc string").repartition(3)
    got = {r.doc_id: r for r in secrets.secret_spans(df).collect()}
    assert len(got) == 14 and secrets.secret_spans(df).count() == 15
    assert got[0].spans == "" and got[0].n_copied == 1 and got[0].n_live == 0
    assert got[20].spans == f"token:4:{4 + len(own)},assign:{9 + len(own)}:{18 + 2 * len(own)}"
    assert got[20].base_sha256 == hashlib.sha256(f"assign:{9 + len(own)}:{18 + 2 * len(own)}".encode()).hexdigest()
    assert got[None].n_assign == 1 and got[21].spans == ""
    masked = {r.doc_id: r.text for r in secrets.masked(df).collect()}
    assert masked[20] == f"see {secrets.MASK} and token = '{secrets.MASK}'"
    assert masked[0] == f"key {copied} end" and masked[21] is None
    assert secrets.masked(df).columns == df.columns and secrets.masked(df).count() == df.count()
    assert secrets.secret_spans(df.limit(0)).count() == 0


def test_values_wide_within_one_source_are_examples(spark):
    wide, own = "q8ZpT1xV9kLm2Rw7Yb3Nc6", "Zk4tQ9sWm1Xv7Lp2Hd8Rj5"
    rows = [(i, f"page {i} has key {wide} end", "hot") for i in range(40)] + [(100 + i, f"see {own} here", f"s{i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: (r.spans, r.n_live, r.n_copied) for r in secrets.secret_spans(df).collect()}
    assert all(got[i] == ("", 0, 1) for i in range(40))
    assert all(got[100 + i] == (f"token:4:{4 + len(own)}", 1, 0) for i in range(40))
    texts = {r.doc_id: r.text for r in secrets.masked(df).collect()}
    assert texts[3] == rows[3][1] and texts[103] == f"see {secrets.MASK} here"
    uses = [(b"v", "a", 1), (b"v", "b", 1), (b"v", "b", 2), (b"v", "b", 2)]
    seen = secrets.ownership(spark.createDataFrame(uses, "value binary, owner string, repository long")).first()
    assert (seen.n_uses, seen.n_repositories, seen.n_owners) == (4, 2, 2)


def test_contexts_find_identifiers_of_unknown_form(spark):
    seeds = [(i, f"Please call the number +1 (555) 100-{1000 + i} today or so") for i in range(6)]
    new = [(10, "Please call the number 555-4711-99 today again"), (11, "the year was 2024 and 1999 too"), (12, None), (None, ""), (13, "a"), (13, "a")]
    df = spark.createDataFrame([(*x, "c") for x in seeds + new], "doc_id long, text string, contexts string").repartition(3)
    got = {r.doc_id: r for r in personal.personal_spans(df).collect()}
    assert got[10].spans == "id:23:34" and got[10].n_id == 1
    assert got[11].spans == "" and got[0].n_phone == 1 and got[0].n_id == 0
    assert personal.personal_spans(df).count() == 12
    assert personal.personal_spans(df.limit(0)).count() == 0
    empty = spark.createDataFrame([], "context string, value binary, seed boolean")
    assert personal.bootstrap(empty).select(F.count("*")).first()[0] == 0
