import pytest
from pyspark.sql import functions as F

from spindrift.functions import identity as I

SAME = [
    (("Prince", "Purple Rain"), ("Prince", "Purple Rain (Remastered 2015)")),
    (("The Beatles", "Yesterday"), ("The Beatles", "Yesterday - Remastered 2015")),
    (("CADMIUM, Chris Linton", "Slow Down"), ("Chris Linton & CADMIUM", "Slow Down")),
    (("A & B", "x1"), ("B and A", "x1")),
    (("Beyoncé", "Halo"), ("Beyonce", "Halo")),
    (("The Beatles", "Help"), ("Beatles", "Help")),
    (("Drake ft. Rihanna", "Take Care"), ("Drake", "Take Care")),
    (("Drake", "Take Care (feat. Rihanna)"), ("Drake", "Take Care")),
    (("prince", " purple rain "), ("PRINCE", "Purple Rain")),
    (("A", "Song (Live) [Remastered]"), ("A", "Song")),
    ((None, None), ("", "")),
]
DIFFERENT = [(("Prince", "Kiss"), ("Cher", "Kiss")), (("The The", "This"), ("Unknown", "This")), (("Prince", "Kiss"), ("Prince", "1999")), (("A", "Song"), ("A", "Song 2"))]


def keys(spark, pairs):
    flat = [p for pair in pairs for p in pair]
    rows = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(flat)], "i int, a string, t string")
    found = {r.i: r.k for r in rows.select("i", I.fuzzy_key(F.col("a"), F.col("t")).alias("k")).collect()}
    return [(found[2 * i], found[2 * i + 1]) for i in range(len(pairs))]


def test_same_tracks_share_a_key(spark):
    for pair, (a, b) in zip(SAME, keys(spark, SAME), strict=True):
        assert a == b, pair


def test_different_tracks_do_not(spark):
    for pair, (a, b) in zip(DIFFERENT, keys(spark, DIFFERENT), strict=True):
        assert a != b, pair


@pytest.mark.parametrize(
    ("isrc", "ids", "key", "tier"),
    [
        (" usrc17607839 ", {"acrcloud": "Z"}, "isrc::USRC17607839", "isrc"),
        (None, {"shazam": "S1", "acrcloud": " Ab "}, "acr::ab", "provider_id"),
        ("  ", {"audd": "", "catalog": "C"}, "cat::c", "provider_id"),
        (None, {}, "fuzzy::a::song", "fuzzy"),
    ],
)
def test_tiers(spark, isrc, ids, key, tier):
    row = spark.createDataFrame([("A", "Song", isrc, ids)], "a string, t string, i string, p map<string,string>")
    found = row.select(I.identity_key(F.col("a"), F.col("t"), F.col("i"), F.col("p")).alias("k")).select("k", I.tier(F.col("k")).alias("tier")).first()
    assert (found.k, found.tier) == (key, tier)


def test_names_that_look_like_tags_stay_in_their_tier(spark):
    """An artist called like a tag, with a title like an id, is no track of that id."""
    rows = spark.createDataFrame([("Cat", "abc", None, {}), (None, None, None, {"catalog": "ABC"}), ("ISRC", "x", None, {}), (None, None, "X", {})], "a string, t string, i string, p map<string,string>")
    found = rows.select(I.identity_key(F.col("a"), F.col("t"), F.col("i"), F.col("p")).alias("k")).select("k", I.tier(F.col("k")).alias("tier")).collect()
    assert [(r.k, r.tier) for r in found] == [("fuzzy::cat::abc", "fuzzy"), ("cat::abc", "provider_id"), ("fuzzy::isrc::x", "fuzzy"), ("isrc::X", "isrc")]
    assert [r.t for r in spark.createDataFrame([("other",), ("",), (None,)], "k string").select(I.tier(F.col("k")).alias("t")).collect()] == ["unknown"] * 3


def test_folding_is_that_of_the_unicode_tables(spark):
    """ASCII letters and digits of the compatibility decomposition, for every character that has some, and beyond the first plane."""
    import unicodedata

    texts = ["".join(map(chr, range(a, a + 64))) for a in (*range(0x80, 0xD800, 64), *range(0xE000, 0x20000, 64))]
    texts = [t for t in texts if "\ud800" not in t]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.k for r in rows.select("i", I.clean_token(F.col("t")).alias("k")).collect()}
    for i, t in enumerate(texts):
        plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
        assert got[i] == "".join(c for c in plain if c.isascii() and c.isalnum()), hex(ord(t[0]))


def test_tags_go_at_any_depth(spark):
    titles = ["Song", "Song (Live)", "Song " + "(Live) " * 9, "Song " + "(live " * 7 + ")" * 7, "Song [Remix (Live)] (2015 Remaster)", "((( Song"]
    rows = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
    got = [r.k for r in rows.select("i", I.without_tags(F.col("t")).alias("k")).orderBy("i").collect()]
    import re

    for title, k in zip(titles, got, strict=True):
        plain, before = title, None
        while plain != before:
            before, plain = plain, re.sub(I.VERSION_TAG.removeprefix("(?iu)"), "", plain, flags=re.I)
        assert k == plain, title
