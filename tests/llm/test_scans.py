import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spindrift.llm import chat_template, html_wrappers, queries, quality_rules, secret_scan, url_filter

from ..compare import assert_same
from .helpers import WORDS, documents, odd_texts

SF = "/root/testdata/sf0.001"
KEY = "aZ3kQ9" + "xW7pL2mN8vB4"
SECRETS = [
    None, "", "no secret = x", "token=ab", 'PassWord: "hunter2hunter2"', "secret=token: abcdefgh", "api-key=1", "APIKEY = 'abc/def+=123' tail", "AKIA" + "Z9" * 8, "AKIAAKIA" + "A" * 11, "akia" + "Z" * 20,
    "0123456789abcdef01234567", "0123456789abcdef0123456", "token=" + "f" * 30, f"{KEY}{KEY} and ſecret=abcdefgh ToKen=abcdefgh", "é" * 5 + "passwd:=abcdef", "d41d8cd98f00b204e9800998ecf8427e", "D41D8CD98F00B204E9800998ECF8427E",
    "123e4567-e89b-12d3-a456-426614174000", "https://x.example.com/" + KEY * 2, "name_of_a_long_variable_with_words_2", "1234567890123456789012345", "x" * 100_000 + " token = " + "q" * 50,
]


def plain_base(text):
    kinds = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    ]
    spans = [(m.start(), k, name, m.end()) for k, (name, p, flags, good) in enumerate(kinds) for m in re.finditer(p, text or "", flags) if good(m)]
    return [(name, a, b) for a, _, name, b in sorted(spans)]


def test_pattern_spans(spark):
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan(documents(spark, SECRETS)).collect()}
    for i, text in enumerate(SECRETS):
        assert [s for s in got[i] if s[0] != "random"] == plain_base(text), text
    rng = random.Random(2)
    bits = ["token", "SECRET", "=", ":", " ", "'", '"', "password", "abc", "ABC123", "0123456789abcdef", "AKIA", "api_key", ".", "\n", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        spans = [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(secret_scan.pattern_spans(text))]
        assert spans == plain_base(text), text


def test_random_strings_but_no_digests_or_names(spark):
    got = {r.doc_id: [SECRETS[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "random"] for r in secret_scan.scan(documents(spark, SECRETS)).collect()}
    assert {i for i, found in got.items() if found} == {SECRETS.index(next(t for t in SECRETS if t and t.startswith(KEY)))}


def randoms(text):
    encoding = secret_scan.token_counter(secret_scan.vocabulary_path("byte_bpe_50k.tiktoken"))
    return [text[a:b] for a, k, b in secret_scan.spans_of(text, encoding, 2.0) if secret_scan.KINDS[k] == "random"]


def test_random_strings_after_dots_and_colons_but_not_in_addresses():
    key, other = KEY * 2, KEY[::-1] * 2
    assert randoms(f"SG.{key}.{other}") == [key, other]
    for before in ("key:", "stripe.live.key: ", "(done.)", "a/b.c:", "see x@ ", "stripe.live.key ", "config."):
        assert randoms(f"{before}{key}") == [key], before
    assert randoms(f"postgres://user:{key}@db.example.com/x") == [key]
    for text in (f"https://x.example.com/a?b={key}", f"WWW.example.com/{key}", f"mail {key}@example.com", f"data:image/png;base64,{key}", f"see (http://example.com/x.y/{key})"):
        assert randoms(text) == [], text


def test_random_values_behind_readable_names():
    key = "k9Qz7Xv2Lp4Wm8Rt3BnJ"
    for before in ("aws_session_credential_value=", "international-administration_configuration_", "configuration/production/environment/"):
        found = randoms(f"x {before}{key} y")
        assert len(found) == 1 and found[0].endswith(key[-18:]) and len(found[0]) <= len(key) + 12, (before, found)
    assert randoms("qZxWvKjYtRbNpLmGhDfS") == ["qZxWvKjYtRbNpLmGhDfS"]
    assert randoms(f"{key}/password=abcdefgh") == [f"{key}/"]
    assert randoms(f"name={key}{key}==") == [f"{key}{key}=="]
    for text in ("getElementsByClassNameOfTheDocument", "python3-dist-packages/numpy/core/include", "name_of_a_long_variable_with_words_2", "id=123e4567-e89b-12d3-a456-426614174000"):
        assert randoms(text) == [], text
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    many = ["".join(rng.choice(letters) for _ in range(24)) for _ in range(500)]
    assert sum(bool(randoms(f"production_credential={x}")) for x in many) >= 490


def test_planted_values_are_the_only_spans():
    """Texts put together from prose, addresses, digests, names and random values: exactly the values are found."""
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    value = lambda n=32: "".join(rng.choice(letters) for _ in range(n))
    quiet = [
        lambda: "the quick brown fox", lambda: f"https://h.example.org/{'dir/' * rng.randrange(30)}{value()}?q={value()}", lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "A" + "9F" * 19 + "B",
        lambda: "getElementsByClassNameOfTheDocument", lambda: "2024-01-01T00:00:00+00:00", lambda: "1234567890123456789012", lambda: f"{value(12)}@mail.example.com", lambda: "_".join(["some", "long", "name"] * 3),
    ]
    missed = 0
    for _ in range(400):
        parts, expected, at = [], [], 0
        for _ in range(rng.randrange(1, 12)):
            if rng.random() < 0.4:
                secret, before = value(), rng.choice(["", "key:", "a.b=", "(", "cfg.key=", "x, y,"])
                parts.append(before + secret)
                expected.append((at + len(before), at + len(before) + len(secret)))
            else:
                parts.append(rng.choice(quiet)())
            at += len(parts[-1]) + 1
        text = " ".join(parts)
        encoding = secret_scan.token_counter(secret_scan.vocabulary_path("byte_bpe_50k.tiktoken"))
        found = [(a, b) for a, k, b in secret_scan.spans_of(text, encoding, 2.0) if k == 3]
        assert all(any(s < b and a < e for s, e in expected) for a, b in found), (text, [text[a:b] for a, b in found])
        missed += sum(not any(s < b and a < e for a, b in found) for s, e in expected)
    assert missed <= 10


def test_many_spans_in_one_text_take_linear_time():
    text = " ".join(f"token=abcdefgh{k} {KEY}{KEY}{k} http://x.example.com/{KEY}{k}" for k in range(8000))
    began = time.time()
    assert len(randoms(text)) == 8000
    assert time.time() - began < 6


def in_urls(text):
    encoding = secret_scan.token_counter(secret_scan.vocabulary_path("byte_bpe_50k.tiktoken"))
    return [text[a:b] for a, k, b in secret_scan.spans_of(text, encoding, 2.0, in_urls=True) if secret_scan.KINDS[k] == "random"]


def test_random_segments_of_urls_and_small_letters():
    rng = random.Random(4)
    value = lambda letters, n=40: "".join(rng.choice(letters) for _ in range(n))
    small = "abcdefghijklmnopqrstuvwxyz"
    found = 0
    for _ in range(200):
        key, low = value(small + small.upper() + "0123456789"), value(small)
        found += in_urls(f"https://x.example.com/a?sig={key}") == [key]
        found += in_urls(f"https://hooks.example.com/services/T00/{key}") == [key]
        found += in_urls(f"key {low}.") == [low]
        assert in_urls(f"data:image/png;base64,{key}{key}") == in_urls(f"{key[:12]}@mail.example.com") == []
    assert found >= 590
    for text in ("kubernetes-deployment-7d9f8b6c5d-x2k4q", "https://x.example.com/some-long-article-title-about-things-2024", "donaudampfschifffahrtsgesellschaft", "https://x.example.com/getElementsByClassNameOfTheDocument", "A" + "9F" * 19 + "B"):
        assert in_urls(text) == [], text


def test_time_grows_with_the_spans():
    times = []
    for n in (16_000, 64_000):
        text = " ".join(f"token=abcdefgh{k % 1000} {KEY}{KEY}" for k in range(n))
        began = time.process_time()
        assert len(randoms(text)) == n
        times.append(time.process_time() - began)
    assert times[1] < 8 * times[0]


def plain_dense(piece, encoding, most):
    """All windows of whole tokens of the least length, one by one; those with few characters a token, joined."""
    tokens = encoding.encode_ordinary(piece)
    if len(piece) <= most * len(tokens):
        return [(0, len(piece))]
    sizes = [len(encoding.decode_single_token_bytes(t)) for t in tokens]
    marks = set()
    for i in range(len(tokens)):
        for j in range(i + 1, len(tokens) + 1):
            if sum(sizes[i:j]) >= secret_scan.LEAST_RUN:
                window = piece[sum(sizes[:i]) : sum(sizes[:j])]
                if len(window) <= most * (j - i) and secret_scan.MIXED.match(window) and any(secret_scan.MIXED.match(w) for w in secret_scan.PART.findall(window)):
                    marks |= set(range(sum(sizes[:i]), sum(sizes[:j])))
                break
    edges = sorted(k for k in range(len(piece)) if k in marks and k - 1 not in marks), sorted(k + 1 for k in range(len(piece)) if k in marks and k + 1 not in marks)
    return list(zip(*edges, strict=True))


def test_dense_stretches_equal_all_windows():
    encoding = secret_scan.token_counter(secret_scan.vocabulary_path("byte_bpe_50k.tiktoken"))
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"
    for _ in range(300):
        parts = [rng.choice(["configuration", "production_", "international", "Administrator", "".join(rng.choice(letters) for _ in range(rng.randrange(4, 40)))]) for _ in range(rng.randrange(1, 6))]
        piece = "".join(parts)
        assert secret_scan.dense(piece, encoding, 2.0) == plain_dense(piece, encoding, 2.0), piece


def test_redaction(spark):
    docs = documents(spark, SECRETS)
    clean = secret_scan.redact(docs)
    assert clean.schema == docs.schema
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[0] is None and texts[1] == "" and texts[4] == '[secret]"' and texts[2] == SECRETS[2]
    assert not any(plain_base(t) for t in texts.values())
    assert secret_scan.scan(docs.limit(0)).count() == 0


def plain_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(spark):
    texts = [t for t in odd_texts() if t is None or len(t) < 60_000] + ["a b c a b c", "x\nx\n x \nx", "#a b$ |<>", "a a a a"]
    got = {r.doc_id: r for r in quality_rules.judge(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeats = plain_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), t
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and not (r.base_failed and r.kept)
    assert quality_rules.judge(documents(spark, ["a"]).limit(0)).count() == 0


def test_hosts(spark):
    """A host of junk is rejected with its rare good page; a small one with as bad a rate is not."""
    rng = random.Random(1)
    good = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(80))
    texts = [*["junk"] * 400, good(), "junk", *(good() for _ in range(300)), "junk", good()]
    sources = [*["bad"] * 401, "tiny", *["fine"] * 300, None, None]
    docs = documents(spark, texts, sources=sources)
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert rows[400].host_rejected and not rows[400].kept and not rows[400].base_failed
    assert not rows[401].host_rejected and rows[500].kept and rows[703].kept and not rows[702].kept
    kept = quality_rules.passing(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}
    assert quality_rules.passing(docs.limit(0)).count() == 0
    clash = docs.withColumns({c: F.lit(7) for c in ("n_words", "n_words_0", "host", "base_failed", "out0_0", "text_0")})
    kept_too = quality_rules.passing(clash)
    assert kept_too.columns == clash.columns and {(r.doc_id, r.text, r.n_words_0) for r in kept_too.collect()} == {(r.doc_id, r.text, 7) for r in kept.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def test_batches_of_large_texts_are_cut(spark):
    """Texts of megabytes in one batch, which operators take in parts, among short and null ones."""
    rng = random.Random(2)
    long = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000)) for _ in range(4)]
    texts = [long[0], "short", None, long[1], long[2], "", f"{long[3]} key: {KEY}{KEY}", "tail"]
    docs = documents(spark, texts).coalesce(1)
    assert {r.doc_id: r.text for r in quality_rules.passing(docs).collect()} == {i: texts[i] for i in (0, 3, 4, 6)}
    assert {r.doc_id: r.n_words for r in quality_rules.judge(docs).collect()} == {i: len((t or "").split()) for i, t in enumerate(texts)}
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert clean == {i: t if i != 6 else f"{long[3]} key: [secret]" for i, t in enumerate(texts)}


def plain_verdict(host, path, at, entries):
    best = None
    domains = [".".join(host.split(".")[k:]) for k in range(len(host.split(".")))] if host else []
    segments = path.lower().split("/") if path else []
    covering = {*domains, *(f"{d}/{'/'.join(segments[:k])}" for d in domains for k in range(1, len(segments) + 1))}
    for (lst, pattern), changes in entries.items():
        now = [c for c in changes if c[0] <= at]
        if pattern in covering and now and now[-1][1] != "remove":
            best = max(best or (), (len(pattern), now[-1][0], lst, now[-1][1] == "allow", pattern))
    return "unlisted" if best is None else "allowed" if best[3] else "blocked"


@pytest.mark.parametrize("broadcast", [64 << 20, -1])
def test_url_filter(spark, monkeypatch, broadcast):
    """Nested hosts, deep paths, all captures below one top domain; with patterns broadcast and not."""
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", broadcast)
    rng = random.Random(5)
    names = ["a.example.com", "b.a.example.com", "example.com", "x.org", "com"]
    rows = [(rng.choice(["s", "t"]), rng.choice([*names, "example.com/en", "x.org/EN", "example.com/en/x", "a.example.com/de/x/y"]), rng.choice(url_filter.ACTIONS), f"2024-01-{rng.randrange(1, 28):02}") for _ in range(60)]
    entries = spark.createDataFrame([*rows, (None, "com", "block", "2024-01-01"), ("s", "com", "odd", "2024-01-01")], "list string, pattern string, action string, at string")
    captures = [(i, rng.choice([f"http://{rng.choice(names)}/{rng.choice(['en', 'EN', '', 'de'])}/{rng.choice(['x', 'X/y', ''])}?y", None, "junk", f"HTTPS://u@{rng.choice(names).upper()}:80"]), rng.choice([None, *(f"2024-01-{d:02} 12:00:00" for d in range(1, 28))])) for i in range(400)]
    df = spark.createDataFrame([*captures, *captures[:9]], "page_id int, url string, fetched_at string")
    got = url_filter.judge(df, entries).collect()
    assert len(got) == 409
    known = {}
    for lst, pattern, action, at in sorted(rows, key=lambda r: (r[3], url_filter.ACTIONS.index(r[2]))):
        changes = known.setdefault((lst, pattern.lower()), [])
        if changes and changes[-1][0] == at + " 00:00:00":
            changes.pop()
        changes.append((at + " 00:00:00", action))
    by_id = dict((r.page_id, r.verdict) for r in got)
    for i, url, at in captures:
        m = re.match(r"(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        s = re.match(r"(?i)https?://[^/?#]*/([^?#]*)", url or "")
        assert by_id[i] == ("unlisted" if not m or at is None else plain_verdict(m[1].lower(), s[1].rstrip("/") if s else "", at, known)), (url, at)
    assert url_filter.judge(df.limit(0), entries).count() == 0 and url_filter.judge(df, entries.limit(0)).where("verdict != 'unlisted'").count() == 0


PAGE = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>Menu {i}</a></ul></nav><div class='ad'>Buy {i}</div>{body}<footer>&copy; {i}</footer>"


def pages(spark, htmls, host="h.example.com"):
    return spark.createDataFrame([(i, f"https://{host}/{i}", h, "x") for i, h in enumerate(htmls)], "page_id long, url string, html string, text string")


def texts_of(df):
    return {r.page_id: r.text for r in html_wrappers.extract(df).collect()}


def test_html_articles(spark):
    bodies = [f"<article><header><h1>Head {i}</h1><p class=byline>By me</p></header><p>One &amp; <b>bo</b>ld {i}<br>two<p>three&nbsp;{i}  \n four<!-- no --><aside>skip</aside><div class='share-bar'>Share</div><section class=comments><article>Reader</article></section></article>" for i in range(6)]
    found = texts_of(pages(spark, [PAGE.replace("{i}", str(i)).replace("{body}", b) for i, b in enumerate(bodies)]))
    assert found == {i: f"Head {i} One & bold {i} two three {i} four" for i in range(6)}


def test_html_without_articles_uses_the_wrapper(spark):
    bodies = [f"<div class=box>Same on all pages</div><div class=post>Body {i} text</div><form>Send</form><p>Tail {i}</p>" for i in range(6)]
    found = texts_of(pages(spark, [PAGE.replace("{i}", str(i)).replace("{body}", b) for i, b in enumerate(bodies)]))
    assert found == {i: f"Body {i} text Tail {i}" for i in range(6)}


def test_html_edges(spark):
    htmls = [None, "", "plain text &lt;here&gt;", "<p>un<b>closed", "<div>" * 5000 + "deep" + "</div>" * 5000, "<article><p>" + "long " * 50_000 + "</article>", "<!-- open", "< 3 &#233;&eacute;&notareal; ", "<article>one</article>", "<article>one</article>"]
    rows = spark.createDataFrame([(i % 9, None if i % 2 else f"http://h{i}.example/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    out = html_wrappers.extract(rows).collect()
    assert len(out) == 10 and all(r.n_chars == len(r.text) for r in out)
    by_url = {r.url: r.text for r in out if r.url}
    assert by_url["http://h2.example/"] == "plain text <here>" and by_url["http://h4.example/"] == "deep" and by_url["http://h8.example/"] == "one"
    assert html_wrappers.extract(rows.limit(0)).count() == 0


def test_html_wrapper_groups():
    a = html_wrappers.tree("<ul><li>1<li>2<li>3</ul><p>x</p>")
    b = html_wrappers.tree("<h2>t</h2><ul><li>1</ul><p>y</p>")
    merged = html_wrappers.align(a, b)
    assert [(n[0], n[1]) for n in merged] == [("h2", "?"), ("ul", "1"), ("p", "1")]
    assert merged[1][2][0][:2] == ["li", "+"] and merged[2][2][0][2][0] is None


def texts_in_python(htmls, host_pages=None):
    """Fold, label and match without Spark, for wrapper tests."""
    trees = [html_wrappers.tree(h) for h in htmls]
    wrapper = trees[0]
    for t in trees[1:]:
        wrapper = html_wrappers.align(wrapper, t)
    fields = html_wrappers.Wrapper(html_wrappers.main_fields(wrapper, len(htmls)))
    return [fields.main_text(h) for h in htmls]


@pytest.mark.parametrize("around", ["<article class='related-stories'>{}</article>", "<div class='side-story'>{}</div>", "<div class=sidebar><article>{}</article></div>", "<div class='hidden-gems'><div class=share>{}</div></div>"])
def test_class_names_never_drop_the_text(around):
    htmls = [f"<body><nav>Menu</nav>{around.format(f'<h1>Head {i}</h1><p>Words of page {i}</p>')}<footer>Foot {i}</footer>" for i in range(5)]
    assert texts_in_python(htmls) == [f"Head {i} Words of page {i}" for i in range(5)]


@pytest.mark.parametrize("depth", [3, 149, 155, 1000])
def test_menus_are_left_out_at_any_depth(depth):
    htmls = [f"{'<div>' * depth}<nav><a href=/>Menu {i}</a></nav><article>Body {i}<aside>link</aside><section class=comments>Said {i}</section></article>{'</div>' * depth}" for i in range(4)]
    assert texts_in_python(htmls) == [f"Body {i}" for i in range(4)]
    plain = [f"{'<div>' * depth}<nav><a href=/>Menu {i}</a></nav>Body {i}<aside>link</aside>{'</div>' * depth}" for i in range(4)]
    assert texts_in_python(plain) == [f"Body {i}" for i in range(4)]


def test_fields_are_known_by_their_place():
    """Two groups with the same tags: one is the template's, one the text."""
    htmls = [f"<div>Same for all</div><h2>Head {i}</h2><div>Text {i}</div><ul><li><a href=/>a {i}</a><li><a href=/>b {i}</a></ul><div>Also the same</div>" for i in range(5)]
    assert texts_in_python(htmls) == [f"Head {i} Text {i}" for i in range(5)]


@pytest.mark.parametrize("html", ["<a title=\"x " * 90_000, "<a title='x " * 90_000 + ">", "<a title=x\"" * 90_000 + "<p>y", "<" * 1_000_000, "<!-- " * 200_000, "</" * 500_000, "<a =" * 250_000, "<p <p " * 170_000, "<div>" * 200_000])
def test_html_takes_linear_time(html):
    began = time.time()
    html_wrappers.parsed(html)
    assert time.time() - began < 5


def test_html_tokens():
    kinds = lambda html: [(k, v) for k, v, _ in html_wrappers.tokens(html)]
    assert kinds("a<b title='1>2'>c</b >d") == [("#", "a"), ("<", "b"), ("#", "c"), ("/", "b"), ("#", "d")]
    assert kinds("x < 3 <p title=it's>y<!-- <p> -->z<?x?><script>if (a<b) {}</script>w") == [("#", "x "), ("#", "<"), ("#", " 3 "), ("<", "p"), ("#", "y"), ("#", "z"), ("<", "script"), ("#", "w")]
    assert kinds("<p title=\"open>one</p><p>two") == [("<", "p"), ("#", "one"), ("/", "p"), ("<", "p"), ("#", "two")]


def test_long_pages_align_in_linear_time():
    """Two pages of a megabyte with 50,000 siblings each, by turns, by chance and shifted against each other."""
    rng = random.Random(8)
    turns = lambda n, first: "".join(f"<h2>{k} a</h2><p>{k} words</p>" for k in range(first, first + n))
    chance = lambda seed: (r := random.Random(seed), "".join(f"<{t}>{k} words here</{t}>" for k in range(50_000) for t in [r.choice(["p", "h2", "div", "pre"])]))[1]
    for a, b in ((turns(25_000, 0), turns(24_000, 5)), (chance(1), chance(2)), ("<pre>x</pre>" + chance(3), chance(3) + "<table></table>")):
        trees = [html_wrappers.tree(x) for x in (a, b)]
        began = time.process_time()
        wrapper = html_wrappers.align(*trees)
        assert time.process_time() - began < 5
        for own in trees:
            it = iter([n[0] for n in wrapper])
            assert all(n[0] in it for n in own)
    assert rng.random() < 1


def test_blocks_of_long_sequences_are_common_and_in_order(monkeypatch):
    rng = random.Random(9)
    total = []
    for _ in range(300):
        left = [rng.choice("abcdefgh") + (str(rng.randrange(400)) if rng.random() < 0.3 else "") for _ in range(rng.randrange(40))]
        right = [x for x in left if rng.random() < 0.8]
        right[rng.randrange(len(right) + 1) :] += [rng.choice("abcxyz") for _ in range(rng.randrange(6))]
        sizes = []
        for most in (0, 50_000):
            monkeypatch.setattr(html_wrappers, "PAIRS", most)
            blocks = html_wrappers.matching(left, right)
            assert all(left[i : i + n] == right[k : k + n] for i, k, n in blocks)
            assert all(i + n <= j and k + n <= m for (i, k, n), (j, m, _) in zip(blocks, blocks[1:], strict=False))
            sizes.append(sum(n for *_, n in blocks))
        total.append((sizes[0], sizes[1], plain_align(left, right)))
    bounded, full, best = (sum(x) for x in zip(*total, strict=True))
    assert bounded >= 0.85 * best and full >= 0.85 * best


def test_text_that_is_all_links_stays():
    htmls = [f"<body><nav><a href=/>Menu</a></nav><div><a href=/{i}>All of the words of page {i}</a></div><footer>x</footer></body>" for i in range(5)]
    assert texts_in_python(htmls) == [f"All of the words of page {i}" for i in range(5)]


def plain_text_of(blocks):
    return " ".join(w for b in blocks for w in b.split())


def test_whole_extraction_of_small_random_pages(spark, monkeypatch):
    """Pages put together from a host's template and random articles: exactly the articles' words, with wrappers sent along and joined."""
    rng = random.Random(10)
    word = lambda: rng.choice(["one", "two", "&amp;", "drei", "quatre", "caf&eacute;", "a<b>b</b>c", "x <i>y</i>"])
    htmls, expected, urls = [], {}, []
    for k in range(60):
        host = k % 4 if k % 2 else 0  # one host has over half of all pages
        blocks = [" ".join(word() for _ in range(rng.randrange(1, 9))) + f" {k}" for _ in range(rng.randrange(1, 6))]
        body = "".join(rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</ul>", "<pre>{}</pre>"]).format(b) for b in blocks)
        ads = "<div class='advert'>Buy</div>" * rng.randrange(2)
        htmls.append(f"<html><head><title>t{k}</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class=h{host}><article>{ads}{body}</article></div><aside>More {k}</aside><form>Send</form><footer>Foot {k}</footer></body></html>")
        urls.append(f"http://h{host}.example/{k}")
        clean = [re.sub("<[^>]*>", "", b).replace("&amp;", "&").replace("&eacute;", "é") for b in blocks]
        expected[k] = plain_text_of(clean)
    rows = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(zip(urls, htmls, strict=True))], "page_id long, url string, html string").repartition(5)
    assert texts_of(rows) == expected
    monkeypatch.setattr(html_wrappers, "BROADCAST_BYTES", 0)
    joined = html_wrappers.extract(rows)
    assert {r.page_id: r.text for r in joined.collect()} == expected
    assert "places" in joined._jdf.queryExecution().analyzed().toString()  # a host with over a quarter of a partition's share is dealt out


def plain_align(a, b):
    """Longest common subsequence of two sequences of distinct neighbours, as a plain table."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_alignment_is_a_common_expression():
    """Every page folded in is matched by the wrapper, and what two pages have in common is merged about as far as can be."""
    rng = random.Random(12)
    block = lambda: rng.choice([f"<h2>{rng.random()}</h2>", f"<p>{rng.random()}</p>", "<ul><li>x<li>y</ul>", f"<div>{rng.random()}<b>z</b></div>", "<pre>same</pre>"])
    merged = possible = 0
    for _ in range(200):
        pages = [f"<article>{''.join(block() for _ in range(rng.randrange(1, 7)))}</article>" for _ in range(2)]
        trees = [html_wrappers.tree(p)[0] for p in pages]
        wrapper = html_wrappers.merge(*trees)
        names = [[n[0] for n in t[2]] for t in (*trees, wrapper)]
        for own in names[:2]:
            it = iter(names[2])
            assert all(n in it for n in own)  # in the wrapper's order
        merged += len(names[0]) + len(names[1]) - len(names[2])
        possible += plain_align(names[0], names[1])
        assert all(n[1] in "?*" for n in wrapper[2] if n[0] not in names[0] or n[0] not in names[1])
        expected = [" ".join(re.sub("<[^>]*>", " ", re.sub("</?b>", "", p)).split()) for p in pages]
        assert texts_in_python(pages) == expected
    assert merged >= 0.9 * possible


def plain_chat(rows):
    talks = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        talks.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in talks.items():
        said = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_chat(spark):
    rng = random.Random(3)
    bits = ["<", "|", "\\", "im_end", "|>", "<|im_end|>\n", "\n", "x", "é", "<|im_start|>assistant\n"]
    rows = [(rng.choice([None, *range(20)]), rng.choice([None, *range(4)]), rng.choice(["user", "assistant", "system", None, "a\nb", "<|x|>\\"]), rng.choice([None, "", *("".join(rng.choices(bits, k=9)) for _ in range(5))])) for _ in range(400)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    back = chat_template.read_back(chat_template.format_conversations(df)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in back} == plain_chat(rows)
    assert chat_template.read_back(chat_template.format_conversations(df.limit(0))).count() == 0


def test_templates():
    render = chat_template.compiled("{% set n = 2 %}{% for m in messages -%}  {{ loop.index * n }}{{ m['text'] | upper }}{% if not loop.last %};{% elif 1 == 2 %}never{% else %}!{% endif %}{%- endfor %}{# gone #}")
    assert render([{"text": "a"}, {"text": "b"}]) == ("2A;4B!", [])
    assert chat_template.fold(chat_template.parse("a{{ 1 + 2 }}{% if 'x' in 'xyz' %}b{% endif %}{{ 'q' | upper }}")) == (("text", "a3bQ"),)
    text, spans = chat_template.compiled("x{% generation %}{{ messages[0].text }}{% endgeneration %}y")([{"text": "abc"}])
    assert text == "xabcy" and spans == [(1, 4)]
    for bad in ("{% for x %}", "{{ a.b() }}", "{{ x | nope }}", "{% if a %}", "{{ 'a }}", "{% else %}", "{{ }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compiled(bad)
    with pytest.raises(chat_template.TemplateError):
        chat_template.compiled("{{ messages.real }}")([])
