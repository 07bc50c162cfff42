"""Operators that read texts one by one, against plain versions."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark import SparkContext
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, common, html, langid, quality, simhash, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_bpe(odd, odd_rows, none):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for r in odd_rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    out = bpe.round_trip(odd, VOCABULARY, ["doc_id"]).collect()
    assert Counter(tuple(r) for r in out) == want
    again = bpe.decode(bpe.encode(odd, VOCABULARY), VOCABULARY)
    assert all(r.decoded == (r.text or "") for r in again.collect())
    assert set(odd.columns) < set(again.columns)
    assert bpe.round_trip(none, VOCABULARY, ["doc_id"]).count() == 0


def test_bpe_random_texts():
    codec, tokenizer, rng = bpe.Codec(bpe.Vocabulary.of(open(VOCABULARY).read())), Tokenizer.from_file(VOCABULARY), random.Random(7)
    texts = ["".join(rng.choice("abcé 1'\n\t<|>endoftx 😀日s\x1c\x85\xa0") for _ in range(rng.randrange(60))) for _ in range(800)] + ["a" * 33, "ab" * 40, " " * 9, "'ll 'S"]
    assert [np.frombuffer(p, "<u4").tolist() for p in codec.encode_batch(texts)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    every = [chr(k) for k in range(256)]
    for _ in range(3000):
        x = "".join(rng.choice(every) for _ in range(rng.randrange(10)))
        assert codec.latin_split(x) == codec.any_split(x)


def test_bpe_holds_a_word_once():
    codec, rng = bpe.Codec(bpe.Vocabulary.of(open(VOCABULARY).read())), random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(1000)) for _ in range(240)]
    tracemalloc.start()
    try:
        assert sum(1 for _ in codec.encode_batch(texts)) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 6e6
    finally:
        tracemalloc.stop()


def test_batches_for_workers_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    texts = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("x"), 5000).alias("text"))
    found = [r.n for r in common.in_batches(texts).mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 10_000_000 and max(found) < 3_000_000


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("sent", [None, 3])
def test_simhash(odd, odd_rows, none, monkeypatch, sent):
    if sent is not None:
        monkeypatch.setattr(common, "MAX_SENT_ROWS", sent)
        monkeypatch.setattr(common, "MAX_ROWS_OF_A_KEY", 2)
    out = simhash.near_classes(odd).collect()
    prints = [plain_fingerprint(r[1]) for r in odd_rows]
    assert Counter((r.doc_id, r.fp & (2**64 - 1)) for r in out) == Counter((r[0], p) for r, p in zip(odd_rows, prints, strict=True))
    reach = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in reach:
            for b in reach:
                if (a ^ b).bit_count() <= 3 and reach[a] < reach[b]:
                    reach[b], changed = reach[a], True
    lowest = {}
    for r, p in zip(odd_rows, prints, strict=True):
        if r[0] is not None:
            lowest[reach[p]] = min(r[0], lowest.get(reach[p], r[0]))
    assert all(r.component_id == lowest.get(reach[r.fp & (2**64 - 1)]) for r in out)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {*lowest.values(), None}
    assert simhash.near_classes(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("long_keys", [False, True])
def test_simhash_links(spark, long_keys):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b for x in base for b in [x, *(x ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(6))]}
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    found = Counter((r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), long_keys=long_keys).collect())
    own = sorted(signed)
    want = {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert set(found) == want and set(found.values()) == {1}


def plain_measures(text):
    words = WORD.findall(text or "")
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), len(lines)


def test_measures():
    rng = random.Random(9)
    for _ in range(1500):
        text = "".join(rng.choice("ab \n\x0b\x1c\x85#é|") for _ in range(rng.randrange(90)))
        assert quality.measures(text) == plain_measures(text)
    assert quality.measures(None) == (0,) * 6
    long = [rng.choice([b"x", b"y", *(b"w%d" % k for k in range(5000))]) for _ in range(30_000)]
    assert quality.repeated_words(long) == plain_measures(" ".join(w.decode() for w in long))[4]


def test_quality(spark, odd, odd_rows, none):
    out = quality.judged(odd).collect()
    assert Counter((r.doc_id, *(r[m] for m in quality.MEASURES)) for r in out) == Counter((r[0], *plain_measures(r[1])) for r in odd_rows)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in out)
    assert quality.judged(none).count() == 0
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    clean = [" ".join(rng.sample(words, rng.randrange(20, 90))) for _ in range(400)]
    junk = [" ".join(w + "%%%" for w in rng.sample(words, 40)) for _ in range(12)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    assert all(kept[k] for k in range(400)) and not any(kept[k] for k in range(400, 412))


def test_quality_of_groups(spark):
    """Small groups have limits of their own, and a source whose texts change is judged otherwise."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    marked = lambda part: " ".join(w + "#" * (rng.random() < part) for w in rng.sample(words, 60))
    rows = [(k, marked(part), lang, source) for k, (lang, source, part) in enumerate((x for x in [("en", "code", 0.4), ("en", "web", 0.0), ("de", "web", 0.0)] for _ in range(150)))]
    probes = [(1000, marked(0.45), "en", "code"), (1001, marked(0.45), "en", "web"), (1002, marked(0.45), "de", "web")]
    judged = lambda rs: {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rs, "doc_id long, text string, lang string, source string")).collect()}
    kept = judged(rows + probes)
    assert (kept[1000], kept[1001], kept[1002]) == (True, False, False) and all(kept[k] for k in range(450))
    changed = [(k, marked(0.4) if source == "web" and lang == "de" else t, lang, source) for k, t, lang, source in rows]
    assert judged(changed + probes)[1002]


def test_sketches(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([0.0, rng.lognormvariate(0, 2)])) for _ in range(4000)]
    sketches = quality.sketch(spark.createDataFrame(rows, "g string, x double"), ["g"], {"x": F.col("x")})
    for by, groups in ((["g"], "ab"), ([], [None])):
        merged = quality.merged(sketches, by)
        for r in quality.quantiles(merged, by, {"q50": 0.5, "q90": 0.9}).collect():
            own = sorted(x for g, x in rows if not by or g == r.g)
            assert r.texts == len(own)
            for q, v in ((0.5, r.q50), (0.9, r.q90)):
                exact = own[max(0, -(-len(own) * int(q * 100) // 100) - 1)]
                assert abs(v - exact) <= 0.0101 * exact
        assert groups


def test_langid(spark, odd, odd_rows, none, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prototypes = langid.train(docs)
    found = {r.doc_id: r for r in langid.identify(docs, prototypes, ["doc_id"]).collect()}
    true = {r.doc_id: r.lang for r in docs.filter(langid.held_out("doc_id")).collect()}
    assert np.mean([found[k].lang_pred == v for k, v in true.items()]) >= 0.9
    assert all(0 <= r.score <= 1 for r in found.values())
    out = langid.identify(odd, prototypes, ["doc_id"]).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in odd_rows)
    by = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert by[1] == by[2] == by[3] == by[10] == ("und", 0.0) and by[5][0] in prototypes
    assert langid.train(none) == {}
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, {}, ["doc_id"]).collect()} == {("und", 0.0)}
    assert langid.identify(none, prototypes, ["doc_id"]).count() == 0


def test_hypervectors():
    p = langid.Profiles(dimensions=64)
    letters = {c: p.bundle([c])[0] for c in "ab"}
    assert any(letters["a"])
    v = [p.vectors[k] for k in range(3)]
    a, b = p.number[ord("a")], p.number[ord("b")]
    want = v[0][0] * v[1][a] * v[2][b] + v[0][a] * v[1][b] * v[2][0]
    assert (p.bundle(["AB!"])[0] == want).all()
    long = "ab ba " * 40_000
    assert np.allclose(p.bundle([long])[0] / 40_000, p.bundle(["ab ba " * 10])[0] / 10, atol=1)


def test_toxicity(spark, odd, odd_rows, none, labels):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    sentence = lambda bad: " ".join([*rng.sample(words, 6), *bad, *rng.sample(words, 2)])
    texts, y = [], []
    for k in range(400):
        toxic = k % 4 == 0
        parts = [sentence([]) for _ in range(rng.randrange(1, 12))]
        if toxic:
            parts[rng.randrange(len(parts))] = sentence([rng.choice(["vileword", "rottenone", "nastything"])])
        texts.append(". ".join(parts))
        y.append(int(toxic))
    model = toxicity.fit(texts[:300], y[:300])
    scores = [model.score(t) for t in texts[300:]]
    assert np.mean([(s >= 0.5) == bool(v) for (s, _), v in zip(scores, y[300:], strict=True)]) >= 0.97
    for (_, spans), t, v in zip(scores, texts[300:], y[300:], strict=True):
        if v and spans:
            assert any(re.search("vileword|rottenone|nastything", t[i:j]) for i, j, _ in spans)
    out = toxicity.score(odd, model, ["doc_id"]).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in odd_rows) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.keep_clean(odd, model).columns == odd.columns and toxicity.keep_clean(odd, model).count() == len(odd_rows)
    assert toxicity.score(none, model, ["doc_id"]).count() == 0
    assert toxicity.train(none, labels).constant == 0.0
    assert toxicity.train(odd, labels.limit(0)).constant == 0.0
    assert 0 <= toxicity.train(odd, labels).score("alpha beta")[0] <= 1


def test_toxicity_starts_no_second_kind_of_workers(odd, labels, monkeypatch):
    want = toxicity.train(odd, labels)

    def parallelize(*args, **more):
        raise AssertionError("rows of Python objects go through an RDD's workers")

    monkeypatch.setattr(SparkContext, "parallelize", parallelize)
    found = toxicity.train(odd, labels)
    assert (found.weights, found.constant) == (want.weights, want.constant)


def test_toxicity_sample(spark, labels):
    """The training texts are whole, within their bound, and of rows that repeat an id one is drawn, in whatever order they come."""
    docs = spark.createDataFrame([(k, ("foul " if k % 2 else "fair ") * (k % 7 + 1) + "word " * 3) for k in range(200, 230)] + [(k, f"repeat {k}") for k in range(200, 210)], "doc_id long, text string")
    seen = []
    fit = toxicity.fit
    try:
        toxicity.fit = lambda texts, y, **more: seen.append((texts, y)) or fit(texts, y, **more)
        for rows in (docs, docs.orderBy("text", ascending=False).repartition(7)):
            for bound in (10_000, 120, 0):
                toxicity.train(rows, labels, max_chars=bound)
    finally:
        toxicity.fit = fit
    assert seen[:3] == seen[3:]
    whole = {r.text for r in docs.collect()}
    assert [sum(map(len, texts)) <= bound for (texts, _), bound in zip(seen, (10_000, 120, 0))] == [True] * 3
    assert all(t in whole for texts, _ in seen for t in texts)
    held = [k for k in range(200, 230) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(seen[0][0]) == 30 - len(held) and 0 < len(seen[1][0]) < 30 and seen[2] == ([], [])


def test_fit_without_contrast():
    assert toxicity.fit([], []).score("x")[0] == 0.0
    assert toxicity.fit(["a", "b"], [1, 1]).score("x")[0] == 1.0


PAGE = '<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><div id="top">Site</div><div class="wrap"><h1>Title {0}</h1><p>Share this page</p><p>One <b>bold {0}</b>\n and&nbsp;more &amp;amp {0}</p><ul><li>a{0}<li>b</ul><div class="promo">x{0}</div><section class="comments"><p>c{0}</p></section></div><!-- x --><div class="foot">f {0}</div></body></html>'


def test_wrapper():
    wrapper = html.induce([PAGE.format(k) for k in range(8)])
    assert html.extract(PAGE.format("Z"), wrapper) == "Title Z\nOne bold Z and more &amp Z\naZ\nb"
    assert html.extract(None, wrapper) == html.extract("", None) == ""
    assert html.extract("<body><p>bare <i>text</i><nav>menu</nav><p>more</bo", None) == "bare text\nmore"
    assert html.extract("<article><h1>A</h1><p>x</p><aside>no</aside></article><footer>f</footer>", None) == "A\nx"


def test_template_in_runs():
    """A fixed line among plain paragraphs goes, and no paragraph with another text in its stead."""
    page = lambda k, n: "<body><div class='wrap'>" + "".join(f"<p>text {k} {i}</p>" + "<p>Subscribe now</p>" * (i == 1) for i in range(n)) + "</div></body>"
    wrapper = html.Wrapper.from_list(html.induce([page(k, 2 + k % 5) for k in range(12)]).to_list())
    for n in (2, 3, 9):
        assert html.extract(page("Z", n), wrapper) == "\n".join(f"text Z {i}" for i in range(n))
    assert html.extract("<body><div class='wrap'><p>one</p><p>two</p></div></body>", wrapper) == "one\ntwo"


def test_large_pages():
    """Pages with many elements are extracted by their host's wrapper, and template behind many siblings is learned."""
    page = lambda k, n: "<body>" + "".join(f"<div>left {i} {k}</div>" for i in range(60)) + f"<div><p>Read this first</p><h1>Title {k}</h1>" + "".join(f"<p><b>text {k} {i}</b></p>" * 20 for i in range(n)) + "</div></body>"
    wrapper = html.induce([page(k, 30) for k in range(8)])
    for n in (2, 300):
        assert html.extract(page("Z", n), wrapper) == "\n".join(["Title Z", *(f"text Z {i}" for i in range(n) for _ in range(20))])


def test_shared_article():
    """Pages of one host that share their article keep it."""
    page = lambda k: f"<body><div class='links'><p>menu {k}</p></div><div class='wrap'><h1>Heading</h1><p>Paragraph one.</p><p>Paragraph two.</p><p>Seen {k} times</p></div></body>"
    wrapper = html.induce([page(k) for k in range(8)])
    assert html.extract(page(9), wrapper).endswith("Heading\nParagraph one.\nParagraph two.\nSeen 9 times")


def test_text_of_some_pages():
    """A heading that half of a host's articles have is theirs, and so is what an article calls discussion or legal; a box on all pages goes."""
    page = lambda k: f"<body><nav>menu {k}</nav><article><h1>Title {k}</h1><div class='box'><h2>Follow us</h2><p>every day</p></div><p>Text {k} says more than the boxes around it.</p>{'<h2>References</h2><p>One source</p>' if k % 2 else ''}<div class='discussion'>We find {k}</div><p class='legal'>Law {k}</p></article></body>"
    wrapper = html.Wrapper.from_list(html.induce([page(k) for k in range(12)]).to_list())
    for k in (3, 4, 77):
        assert html.extract(page(k), wrapper) == "\n".join([f"Title {k}", f"Text {k} says more than the boxes around it.", *(["References", "One source"] if k % 2 else []), f"We find {k}", f"Law {k}"])
    assert html.extract(page(3), None).endswith("We find 3\nLaw 3")


@pytest.mark.parametrize("menu", ["<div>Menu {0} item</div>", "<div><p>Menu {0} a</p><p>Menu {0} b</p></div>", "<ul><li>Menu {0}</li></ul>", "<div>" + "".join(f"<a>Menu {{0}} item {i}</a>" for i in range(40)) + "</div>"])
def test_article_beside_varying_menu(menu):
    """The article that all pages of a host share is kept, not the menu that varies, though both are plain elements."""
    lines = ["A long sentence of the article, and another of its sentences after it. " * 4, "The second paragraph, with less to say."]
    page = lambda k: f"<body>{menu.format(k)}<div>{''.join(f'<p>{x}</p>' for x in lines)}</div></body>"
    wrapper = html.Wrapper.from_list(html.induce([page(k) for k in range(8)]).to_list())
    assert html.extract(page(2), wrapper) == "\n".join(x.strip() for x in lines)


def test_many_siblings():
    """Thousands of siblings are aligned within a band: the work grows with their number, and template among them is still found."""
    page = lambda k, n: "<body><article>" + "".join(f"<h2>h {k} {i}</h2><p>p <b>{k} {i}</b></p>" for i in range(n)) + "</article><div><p>Read also</p></div></body>"
    began = time.process_time()
    wrapper = html.induce([page(k, 1300) for k in range(2)])
    assert time.process_time() - began < 10
    assert html.extract(page("Z", 1300), wrapper) == "\n".join(x for i in range(1300) for x in (f"h Z {i}", f"p Z {i}"))
    band = html._band(3, 40_000)
    assert band[0][0] == 0 and band[-1][1] == 40_000 and all(low <= high for (_, high), (low, _) in zip(band, band[1:], strict=False))


def test_odd_markup():
    """Deep nesting, quotes in unquoted values, an unclosed value, a heading that names itself a header."""
    deep = "<div>" * 50_000 + "<p>one</p>two" + "</div>" * 50_000
    wrapper = html.Wrapper.from_list(html.induce([deep.replace("one", f"one {k}") for k in range(6)]).to_list())
    assert html.extract(deep, wrapper) == html.extract(deep, None) == "one\ntwo"
    assert html.extract("<p title=it's>one</p><p class='x' title=\"a>b\">two</p>", None) == "one\ntwo"
    assert html.extract("<article><h1 class='post-header'>Title</h1><p>x</p></article>", None) == "Title\nx"


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = {r.page_id: r.text for r in html.main_text(pages, ["page_id", "url"]).collect()}
    import html as library

    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)
        parts = re.split(r"</?(?:p|h1|article)[^>]*>", article[1]) if article else []
        assert out[r.page_id] == "\n".join(x for x in (" ".join(library.unescape(re.sub(r"<[^>]*>?", "", p)).split()) for p in parts) if x)
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "http://h/a", "", None), (None, "nonsense", "<p>a", "y"), (4, "http://h/a", "<article>" + "<p>z</p>" * 30_000, "z")], "page_id long, url string, html string, host string")
    assert {(r.page_id, len(r.text)) for r in html.main_text(odd, ["page_id"]).collect()} == {(1, 0), (2, 0), (None, 1), (4, 59_999)}
    assert html.main_text(odd.limit(0), ["page_id"]).count() == 0
