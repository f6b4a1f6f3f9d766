"""Random texts of fragments whose cleaned form is known: the chain cleans each fragment on its own."""

import random

from veerline.functions import text as T

# (fragment, what is left of it), written down by hand
FRAGMENTS = [("plain words", "plain words"), ("@name_1", ""), ("https://a.b/c?d=1", ""), ("http://x.y", ""), ("#tag9", ""),
             ("#é", ""), ("&amp;", "&"), ("&lt;b", "<b"), ("a\n\n\nb", "a\nb"), ("zzz", ""), ("xzzzy", "xy"), ("RT x", "x"),
             ("あ é", "あ é"), ("1.5", "1.5"), ("e@", "e@"), ("!", "!"), ("　.", " .")]
BLANKS = " \t\n　\x1c"


def test_each_fragment_is_cleaned(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        picked = [rnd.choice(FRAGMENTS) for _ in range(rnd.randint(0, 12))]
        ends = [rnd.choice(["", " ", "\n\n", "\x1c"]) for _ in range(2)]
        left = " ".join(after for _, after in picked)
        # blanks at the ends go before entities and the wide blank are decoded
        rows.append((i, ends[0] + " ".join(f for f, _ in picked) + ends[1], left.strip(BLANKS)))
    df = spark.createDataFrame([r[:2] for r in rows], "i int, s string")
    got = {r.i: r.o for r in df.select("i", T.clean_text("s", ["zzz"]).alias("o")).collect()}
    for i, s, want in rows:
        assert got[i].strip(BLANKS) == want, (s, got[i], want)


def test_counts_of_any_type(spark):
    row = spark.createDataFrame([("57", "1.2K", 57.0, 57)], "a string, b string, c double, d int")
    got = row.select(*[T.parse_abbrev_count(c).alias(c) for c in "abcd"]).first()
    assert tuple(got) == (57, 1200, 57, 57)
