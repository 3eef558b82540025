import random
import re

from pyspark.sql import functions as F

from meridian.llm import pii
from meridian.llm.queries import URL_RULES
from meridian.llm.url_filter import rule_table, url_filter

from . import helpers


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = host.translate(helpers.LOWER)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_random_urls_and_nested_rules(spark):
    rng = random.Random(4)
    rules = [*URL_RULES, ("block", "a.b.example.org", "/"), ("allow", "a.b.example.org", "/x/y"), ("block", "example.org", "/es/a/"), ("allow", "net", "/p"), ("block", "net", "/p%q")]
    hosts = ["org", "example.org", "EXAMPLE.org", "www.example.org", "a.b.example.org", "z.a.b.example.org", "badexample.org", "com", "x.com", "net", "y.net:80", "", "..", "user@x.com"]
    paths = ["", "/", "/es/", "/es/a/b", "/en/1", "/en/12?x", "/en/2", "/fr/", "/de/#f", "/x/y/z", "/p%q", "/p\n", "?q=/es/", "#://"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(600)] + [None, "", "no scheme", "a://b://c/d", "http:/x.org/"]
    got = url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5), rule_table(spark, rules)).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}


def test_url_filter_is_native(spark, sf_dir):
    df = url_filter(helpers.table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian|ExistingRDD", plan)
    assert url_filter(helpers.table(spark, sf_dir, "pages"), rule_table(spark, [])).where("verdict <> 'allow' or rule is not null").count() == 0


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(int(c) for c in reversed(d))) % 10 == 0


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m.group())]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def test_base_spans_of_adversarial_texts(spark):
    rng = random.Random(8)
    bits = ["a.b@c.d-e.f", "x@y", "@", "a@b.c_d@e.f", "..", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.255", "4111 1111-1111 1111", "4111111111111112", "+1 (212) 555-0100", "+1--", "+", "5", " ", "-", "é😀", "\n", "%+-._@q.w", "12345678901234567890", "a1@b-c.d", "+49.30.1234567(", "1 2 3 4 5 6 7 8 9 0 1 2 3"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(800)] + ["", None, "a" * 50_000, "1" * 30_000 + " x@y.z", "a." * 20_000 + "@b.c", "1 " * 20_000, "+" + "1" * 20_000]
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).select("doc_id", "base", "spans").collect()
    for r in rows:
        want = plain_spans(texts[r.doc_id] or "")
        assert [tuple(s) for s in r.base] == want, texts[r.doc_id][:100]
        spans = [tuple(s) for s in r.spans]
        assert set(want) <= set(spans) and spans == sorted(spans, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_trees_find_assigned_secrets_and_redaction(spark, sf_dir):
    docs = helpers.table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    found = pii.personal_data(docs).select("doc_id", "text", "base", "spans", pii.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    secrets = 0
    for r in found:
        assert [tuple(s) for s in r.base] == plain_spans(r.text)
        at, out = 0, []
        for s in r.spans:  # base spans of different kinds may overlap; then the first one's mark stands
            if s.start >= at:
                out += [r.text[at : s.start], f"[{s.kind.upper()}]"]
            at = max(at, s.end)
        assert r.clean == "".join(out) + r.text[at:]
        secrets += sum(s.kind == "secret" for s in r.spans)
        for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text):
            assert any(s.start <= m.start(1) and s.end >= m.end(1) for s in r.spans)
    assert secrets > 5


def planted(rng, n):
    """Texts with secrets: some assigned to a token, some bare; and what only looks a little like one."""
    letters, rows, bare, other = "bcdfghklmnprstvw", [], [], []
    word = lambda: "".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(rng.randrange(1, 5)))
    code = lambda size: "".join(rng.choice("0123456789abcdef") for _ in range(size))
    for i in range(n):
        words, what = [word() for _ in range(40)], i % 4
        if what == 0:
            words[20] = f'token = "{code(40)}"'
        elif what == 1:
            words[20] = code(40)
            bare.append((i, words[20]))
        elif what == 2:
            words[20] = f"{word()}_{word()}_{word()}_{word()}_{rng.randrange(100)}"
            other.append((i, words[20]))
        rows.append((i, " ".join(words)))
    return rows, bare, other


def test_secrets_are_known_by_their_looks(spark):
    """Bare ones are positives by none of the labels: the trees know them from the assigned ones. The table wasn't used to set the threshold."""
    rows, bare, other = planted(random.Random(71), 1200)
    got = {r.doc_id: (r.text, [tuple(s) for s in r.spans]) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "text", "spans").collect()}
    hit = lambda i, w: any(k == "secret" and got[i][0][a:b] == w for a, b, k in got[i][1])
    assert len(other) > 200 and not any(hit(i, w) for i, w in other)
    clean = [i for i, _ in rows if i % 4 == 3]
    assert not any(got[i][1] for i in clean)
    assert sum(hit(i, w) for i, w in bare) > 0.95 * len(bare)


def test_pii_is_native(spark, sf_dir):
    plan = pii.personal_data(helpers.table(spark, sf_dir, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_boosting_and_calibration():
    n = len(pii.FEATURES)
    cell = lambda **k: tuple(k.get(f, 0) for f in pii.FEATURES)
    cells = [(cell(kind=2, hex=1), 1, 99), (cell(kind=2), 98, 2), (cell(kind=1, digits=5, plus=1), 5, 95), (cell(kind=1, digits=5), 95, 5)]
    model = pii.grow(cells, 30, 0.4)
    a, b = pii.platt([(pii.margin_of(model, x), neg, pos) for x, neg, pos in cells])
    for x, neg, pos in cells:
        assert len(x) == n and abs(1 / (1 + pii.math.exp(-(a * pii.margin_of(model, x) + b))) - pos / (neg + pos)) < 0.06
