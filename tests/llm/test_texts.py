from __future__ import annotations

import html
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from carrygrid.llm import gumbel, html_text, language, packing, pieces, quality, token_counts, toxicity
from tests.llm import brute


def test_statistics_equal_brute_force(docs, labels, odd, none):
    for table in (docs, odd):
        texts = Counter((r.doc_id, brute.statistics(r.text)) for r in table.select("doc_id", "text").collect())
        found = quality.report(table, labels).collect()
        assert Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in found) == texts
        assert not any(r.kept for r in found if r.base_failed)
    assert quality.report(none, labels).count() == 0
    assert quality.keep_good(odd, labels).dtypes == odd.dtypes
    assert quality.report(docs, labels.limit(0)).count() == docs.count()


def test_ratio_tells_good_from_bad(docs, labels):
    found = quality.report(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in found if r.quality == 1]
    bad = [r.kept for r in found if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2


def test_all_good_labels_count(spark):
    """More good labels than any limit, ids of all sizes; of two texts one is labelled good."""
    ids = [-(2**63), -65, -1, 0, 63, 64, 2**62 + 1, 2**63 - 1]
    graded = spark.range(1000, 24_000).selectExpr("id AS doc_id", "1 AS quality")
    graded = graded.unionByName(spark.createDataFrame([(i, 1) for i in ids] + [(None, 1), (65, 0)], "doc_id long, quality int"))
    rows = [(i, "fine") for i in [*ids, *range(1000, 24_000)]] + [(i, "poor") for i in (65, 1, -2, 2**62, 999, 24_000, None)]
    found = quality.log_ratios(spark.createDataFrame(rows, "doc_id long, text string"), graded)
    fine, poor = (zlib.crc32(w.encode()) % quality.BUCKETS for w in ("fine", "poor"))
    n, size = 23_000 + len(ids), quality.BUCKETS
    raw = n + 7 + size
    assert found[fine] == math.floor(1e6 * math.log(float(n + 1) * raw / (float(n + 1) * (n + size))))
    assert found[poor] == math.floor(1e6 * math.log(float(raw) / (8.0 * (n + size))))


def test_quality_runs_no_python(docs, labels):
    plan = quality.report(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_toxicity_finds_insults_only(spark, docs, labels, odd, none):
    more, graded = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    found = toxicity.report(more, graded).join(graded, "doc_id").where("held_out").collect()
    assert sum(r.predicted for r in found if r.toxic == 1) > 0.7 * sum(r.toxic for r in found)
    assert sum(r.predicted for r in found if r.toxic == 0) <= 2
    assert toxicity.report(odd, labels).count() == odd.count()
    assert toxicity.report(none, labels).count() == 0
    assert {r.predicted for r in toxicity.report(docs, labels.limit(0)).collect()} == {0}
    kept = toxicity.keep_harmless(odd, labels)
    assert kept.dtypes == odd.dtypes


def test_counterfactual_penalty_keeps_identity_terms_neutral(spark):
    """In the training texts one group is mentioned in toxic texts only; that must not carry the verdict."""
    neutral = "the people of this town and their neighbours met today"
    rows = [(i, f"{neutral} {i} muslim you idiot fool" if i % 2 else f"{neutral} {i} christian bakery") for i in range(300)]
    rows += [(1000, f"{neutral} muslim bakery"), (1001, f"{neutral} christian idiot fool")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")

    def scores(penalty):
        model = toxicity.train(docs, labels, penalty=penalty)
        return {r.doc_id: r.score for r in toxicity.score(docs, model).where("doc_id >= 1000").collect()}

    free, fair = scores(0.0), scores(1.0)
    assert fair[1000] < free[1000] and fair[1000] < 0.5 < fair[1001]
    assert toxicity.swapped("Muslims and a Muslim, muslimsx") == "jews and a jewish, muslimsx"


def test_language(docs, odd, none):
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = [r for r in language.report(docs).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    known = {r.doc_id: r for r in language.report(odd).collect()}
    assert all(known[i].lang_pred == "und" and known[i].score == 0 for i in (1, 2, 3, 11))
    assert known[7].lang_pred == "en"
    assert language.report(none).count() == 0


def test_language_vectors_are_bound_by_place():
    letters = language.is_letter()
    one, same, turned = language.bundles(["abc", "ABC!", "cba"], letters)
    assert (one == same).all() and not (one == turned).all()
    alone, both = language.bundles(["abc", "abc def"], letters), language.bundles(["abc def", "abc"], letters)
    assert (alone[0] == both[1]).all() and (alone[1] == both[0]).all()


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def segmentations(vocabulary, word):
    logs = {vocabulary.names[i]: x for i, x in zip(vocabulary.ids, vocabulary.logs)}
    if not word:
        yield (), 0.0
    for n in range(1, min(16, len(word)) + 1):
        head = word[:n]
        if head in logs or n == 1:
            own = logs.get(head, len(head.encode()) * vocabulary.byte_log)
            for rest, x in segmentations(vocabulary, word[n:]):
                yield (head, *rest), own + x


def test_token_counts_equal_brute_force(spark, docs, odd, none, vocabulary):
    def best(word):
        found = list(segmentations(vocabulary, word))
        top = max(x for _, x in found)
        return {sum(len(p.encode()) if p not in known else 1 for p in s) for s, x in found if x > top - 1e-9}

    known = {vocabulary.names[i] for i in vocabulary.ids}
    texts = ["the ed thea on", "Über 漢 \U0001f600", "", "a  b\nc", "thention nted"]
    found = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        words = re.findall("▁*[^▁]*", pieces.normal(texts[r.doc_id]))
        assert r.n_pretokens == sum(map(bool, words))
        sums = {sum(c) for c in itertools.product(*[best(w) for w in words if w])}
        assert r.n_tokens in sums
    assert token_counts.count_tokens(odd).count() == odd.count()
    assert token_counts.count_tokens(none).count() == 0
    # The split into chunks changes nothing.
    some = [r.text for r in docs.select("text").limit(50).collect()]
    whole = pieces.PreTokens.of(some)
    together = np.bincount(whole.owner, token_counts.terminal_counts(whole, vocabulary)[whole.word], minlength=len(some))
    for text, n in zip(some, together):
        one = pieces.PreTokens.of([text])
        assert token_counts.terminal_counts(one, vocabulary)[one.word].sum() == n


def test_samples_follow_the_model(vocabulary):
    text, n, k = "thea on", 6000, 3
    words = re.findall("▁+[^▁]*", pieces.normal(text))
    chance = {}
    for parts in itertools.product(*[list(segmentations(vocabulary, w)) for w in words]):
        chance[sum((p[0] for p in parts), ())] = math.exp(sum(p[1] for p in parts))
    total = sum(chance.values())
    chance = {s: p / total for s, p in chance.items()}
    found = pieces.PreTokens.of([text] * n)
    search = gumbel.Search(found, gumbel.Lattice.of(found, vocabulary), np.arange(n), k)
    search.run()
    drawn = [search.ids(i, vocabulary) for i in range(k)]
    rows = [[tuple(vocabulary.names[x] for x in ids[b[i] : b[i + 1]]) for ids, b in drawn] for i in range(n)]
    live = np.array([s.live for s in search.samples]).T
    assert all(len({s for s, ok in zip(r, o) if ok}) == o.sum() for r, o in zip(rows, live))
    first, pairs = Counter(r[0] for r in rows), Counter((r[0], r[1]) for r in rows)
    top = sorted(chance, key=chance.get)[:-4:-1]
    for a in top:
        assert abs(first[a] / n - chance[a]) < 0.03
        for b in top:
            if a != b:
                assert abs(pairs[a, b] / n - chance[a] * chance[b] / (1 - chance[a])) < 0.03


def test_lattices_hold_the_edges_that_exist(vocabulary):
    """No more, however long the longest piece beside them; the chances are those of all segmentations."""

    def lattice(texts):
        found = pieces.PreTokens.of(texts)
        return found, gumbel.Lattice.of(found, vocabulary)

    def held(own):
        return sum(a.nbytes for name, a in vars(own).items() if isinstance(a, np.ndarray) and not name.endswith("_of"))

    texts = ["".join(word) for word in itertools.product("xzqé", repeat=5)]
    wide = vocabulary.names[max(vocabulary.ids, key=lambda i: len(vocabulary.names[i].strip("▁")))].replace("▁", " ").strip()
    assert held(lattice([*texts, wide])[1]) < 1.1 * held(lattice(texts)[1])
    known = {vocabulary.names[i] for i in vocabulary.ids}
    words = ["the", "an", "weather", "N/A", "漢字é", "\U0001f600a"]
    found, own = lattice(words)
    for n, (a, size) in enumerate(zip(found.start, found.length)):
        word = "".join(map(chr, found.points[a : a + size]))
        chance = [math.exp(x) for _, x in segmentations(vocabulary, word)]
        assert math.isclose(own.mass[n], math.log(math.fsum(chance)), rel_tol=1e-12)
    whole = ["".join(map(chr, found.points[a : a + size])) for a, size in zip(found.start, found.length)]
    assert len(own.before) == sum(j == i + 1 or w[i:j] in known for w in whole for i in range(len(w)) for j in range(i + 1, len(w) + 1))


def test_sums_beyond_the_range_of_doubles(vocabulary):
    """Runs of rare characters, or of one long piece: finite masses, both samples, the same alone and among others."""
    texts = ["\U0001f9ff" * 40 + " and", "漢" * 399 + " and", " " * 390, "plain words", "x"]

    def run(some, keys):
        found = pieces.PreTokens.of(some)
        own = gumbel.Lattice.of(found, vocabulary)
        search = gumbel.Search(found, own, np.array(keys), 2)
        bar = search.run()
        assert np.isfinite(own.mass).all() and all(s.live.all() and np.isfinite(s.value).all() for s in search.samples)
        return [[(s.log[i], s.value[i], bar[i]) for s in search.samples] for i in range(len(some))]

    together = run(texts, range(len(texts)))
    assert all(run([text], [i])[0] == together[i] for i, text in enumerate(texts))


def test_ids_of_spelled_characters(vocabulary):
    texts = ["\U0001f9ff\u0378 \ud800x \u07c0", "\U0010ffff\x01", "é\ufdd0"]
    found = pieces.PreTokens.of(texts)
    search = gumbel.Search(found, gumbel.Lattice.of(found, vocabulary), np.arange(len(texts)), 2)
    search.run()
    for number in range(2):
        ids, bounds = search.ids(number, vocabulary)
        for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
            spelled = [bytes([i - vocabulary.first_byte]) if 0 <= i - vocabulary.first_byte < 256 else vocabulary.names[i].encode() for i in ids[a:b].tolist()]
            assert b"".join(spelled) == pieces.normal(text).encode("utf-8", "surrogatepass")


def test_second_samples_of_words_with_one_likely_form(vocabulary):
    """Whatever the mass of the likeliest form, each text has its second segmentation, by the chances of the others."""
    n = 400
    texts = ["a", "N/A", "weather", "Hello", "house"]
    found = pieces.PreTokens.of(texts * n)
    search = gumbel.Search(found, gumbel.Lattice.of(found, vocabulary), np.arange(n * len(texts)), 2)
    bar = search.run()
    assert all(s.live.all() for s in search.samples)
    drawn = [search.ids(i, vocabulary) for i in range(2)]
    for place, text in enumerate(texts):
        chance = {s: math.exp(x) for s, x in segmentations(vocabulary, pieces.normal(text))}
        pairs = [tuple(tuple(vocabulary.names[x] for x in ids[b[i] : b[i + 1]]) for ids, b in drawn) for i in range(place, len(texts) * n, len(texts))]
        assert all(a != b and a in chance and b in chance for a, b in pairs)
        assert (np.isfinite(bar[place :: len(texts)]) == (len(chance) > 2)).all()
        first = max(chance, key=chance.get)
        rest = sum(p for s, p in chance.items() if s != first)
        after = Counter(b for a, b in pairs if a == first)
        for form in sorted(chance, key=chance.get)[:-4:-1]:
            if form != first:
                assert abs(after[form] / after.total() - chance[form] / rest) < 0.1


def test_samples_decode_to_their_texts(spark, docs, odd, none):
    for table in (docs.limit(200), odd):
        found = gumbel.decoded(gumbel.segmentations(table, k=3)).collect()
        texts = {(r.doc_id, r.text or "") for r in table.collect()}
        assert all((r.doc_id, r.decoded) in texts for r in found)
        assert {r.doc_id for r in found} == {i for i, _ in texts}
        assert all(0 <= r.inclusion <= 1 for r in found)
        groups = Counter((r.doc_id, r.decoded, tuple(r.ids)) for r in found if r.doc_id not in (None, 8))
        assert set(groups.values()) == {1}
    again = gumbel.segmentations(docs.limit(200).repartition(7), k=2)
    assert {(r.doc_id, r.sample, tuple(r.ids)) for r in again.collect()} <= {
        (r.doc_id, r.sample, tuple(r.ids)) for r in gumbel.segmentations(docs.limit(200), k=2).collect()
    }
    assert gumbel.segmentations(none).count() == 0
    assert "ids_crc32" in gumbel.digest(odd).columns


def test_ids_equal_the_tokenizers_library():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ranks, special = packing.vocabulary(packing.TOKENIZER)
    bpe = packing.encoder(ranks, special)
    for text in ["", "a", "Hello  world\n\n it's 漢字 \U0001f600", "x<|endoftext|>y <|endoftext|>", "\t\r\n  ", "é" * 50]:
        assert packing.encode(bpe, special, text) == own.encode(text, add_special_tokens=False).ids


def test_packing(spark, docs, odd, none):
    for table, limit in ((docs, 1.05), (odd, 1.2)):
        found = packing.sequences(spark, table).toPandas()
        assert found.length.between(1, packing.CAPACITY).all()
        placed = found.sort_values(["sequence_id", "offset"])
        assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
        assert placed.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
        assert found.sequence_id.nunique() <= limit * -(-found.length.sum() // packing.CAPACITY) + 1
        assert set(found.doc_id.dropna()) == {r.doc_id for r in table.collect() if r.doc_id is not None}
    own = Tokenizer.from_file(packing.TOKENIZER)
    for r in odd.where("doc_id in (1, 7, 12)").collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids + [0]
        mine = packing.sequences(spark, odd.where(f"doc_id = {r.doc_id}")).orderBy("piece").collect()
        assert [(p.start, p.length) for p in mine] == packing.cuts(len(ids))
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in mine)
    assert packing.sequences(spark, none).count() == 0


def test_cuts():
    assert packing.cuts(10, 4) == [(0, 2), (2, 4), (6, 4)]
    assert packing.cuts(8, 4) == [(0, 4), (4, 4)]
    assert packing.cuts(3, 4) == [(0, 3)]


def test_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in rows.collect()}
    for r in html_text.extract(spark, rows).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", "", x))).strip() for x in re.split(r"</?p>|</?h1>", inner)]
        assert r.text == "\n".join(x for x in blocks if x)
        assert r.n_chars == len(r.text) and r.n_templates in (0, 3)


def test_recurring_subtrees_go_where_nothing_names_them(spark):
    """No names or classes tell: only the counts per host do."""
    def page(i, host):
        own = " ".join(f"w{i}x{k}" for k in range(30))
        return (i, f"http://{host}/{i}", f"<body><div><p>Common {host} strip</p></div><div><p>{own}</p><p>Said on every page</p></div></body>", "h")

    rows = [page(i, "a.org") for i in range(8)] + [page(9, "b.org"), (10, None, None, "h"), (11, "odd", "", "h"), (12, "odd", "plain &amp; text", "h")]
    found = {r.page_id: r for r in html_text.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert all("Common" not in found[i].text and "Said" not in found[i].text and f"w{i}x29" in found[i].text for i in range(8))
    assert "Said on every page" in found[9].text
    assert found[10].text == "" and found[11].text == "" and found[12].text == "plain & text"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(spark, empty).count() == 0


def test_recurring_subtrees_go_on_a_host_of_any_size(spark):
    """A block on 30 pages goes, be they all of its host or a few hundredths of it."""
    def page(i, host):
        strip = "<div><p>Said on thirty pages</p></div>" if i < 30 else ""
        return (i, f"http://{host}/{i}", f"<body><div><p>{' '.join(f'w{i}x{k}' for k in range(30))}</p>{strip}</div></body>")

    rows = [page(i, "small.org") for i in range(40)] + [page(i, "large.org") for i in range(700)]
    found = html_text.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 740 and all("Said" not in r.text and f"w{r.page_id}x29" in r.text for r in found)


def test_counts_decide_inside_an_article(spark):
    """A subscription line on every page goes without a name; what only sounds like boilerplate stays where it does not recur."""
    def words(name):
        return " ".join(f"{name}{k}" for k in range(30))

    def page(i):
        own = f"<div class='notice header'><p>{words(f'notice{i}x')}</p></div>" if i == 3 else ""
        related = f"<div class='comments'><p>{words(f'reader{i}x')}</p></div>"
        return f"<body><article><h1>Title {i}</h1>{own}<p>{words(f'w{i}x')}</p>{related}<div><p>Write to us for the letter</p></div></article></body>"

    def near(i):  # near copies of one article are no template of each other
        return f"<body><article><h1>Same</h1><p>{words('same')}</p><p>{words('again')} {words('more')}</p><p>{i}</p></article></body>"

    rows = [(i, "http://a.org/", page(i)) for i in range(8)] + [(100 + i, "http://a.org/", near(i)) for i in range(8)]
    rows += [(200, "http://b.org/", page(3))]
    found = {r.page_id: r.text for r in html_text.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert "Write to us" not in found[i] and "reader" not in found[i] and f"Title {i}" in found[i] and f"w{i}x29" in found[i]
        assert found[100 + i] == f"Same\n{words('same')}\n{words('again')} {words('more')}\n{i}"
    assert "notice3x29" in found[3]
    assert "notice3x29" not in found[200] and "Write to us" in found[200]


def test_split_articles_stay_whole(spark):
    """Nothing is named, and the parts have parents of their own."""
    def page(i):
        parts = "".join(f"<section><p>Part {k} of {i} {' '.join(f'w{i}x{k}x{n}' for n in range(5 + 9 * k))}</p></section>" for k in range(4))
        return f"<body class='no-sidebar'><nav>Way {i}</nav><div><h1>Title {i}</h1></div><div id='content'>{parts}</div><div>Imprint</div></body>"

    rows = [(i, "http://a.org/", page(i)) for i in range(8)] + [(9, "http://b.org/", page(9))]
    for r in html_text.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        lines = r.text.split("\n")
        assert lines[0] == f"Title {r.page_id}" and [x[:6] for x in lines[1:5]] == [f"Part {k}" for k in range(4)]
        assert lines[5:] == (["Imprint"] if r.page_id == 9 else [])


def test_parsing():
    page = html_text.Page(
        html_text.parse(
            "<article><h1>T &amp; t</h1><p>One<br>two  three<p>Four <i>five</i><aside>side</aside><form>x<input></form>"
            "<div class='share-buttons'>Share</div><ul><li>a<li>b</ul><script>var a='</p>'</script><!-- <p>no</p> -->"
            "<section id=comments><p>Nice!</p></section><table><tr><td>c<td>d</table></article><footer>f</footer>"
        )
    )
    text = html_text.main_text(page.texts, page.owners, page.around, [False] * len(page.hashes), page.alone)[0]
    assert text == "T & t\nOne two three\nFour five\na\nb\nc\nd"


def test_samples_do_not_depend_on_the_chunk(docs, vocabulary):
    """Each text alone gives the very numbers that it gives among others, a long pre-token among them too."""
    texts = [r.text for r in docs.limit(60).collect()] + ["x" * 500, "", "a"]

    def run(some, keys):
        found = pieces.PreTokens.of(some)
        search = gumbel.Search(found, gumbel.Lattice.of(found, vocabulary), np.array(keys), 3)
        bar = search.run()
        return [[(s.log[i], s.value[i], bar[i], s.live[i]) for s in search.samples] for i in range(len(some))]

    together = run(texts, range(len(texts)))
    assert all(run([text], [i])[0] == together[i] for i, text in enumerate(texts))


def test_long_pretokens(vocabulary):
    word = np.random.default_rng(1).choice(list("abcdetionrs漢é"), 300).astype(str)
    texts = ["".join(word[:n]) for n in (127, 128, 129, 200, 300)]
    found = pieces.PreTokens.of(texts)
    assert token_counts.terminal_counts(found, vocabulary).tolist() == token_counts._shared_counts(found, vocabulary).tolist()
    long = pieces.PreTokens.of(["x" * 20_000])
    assert token_counts.terminal_counts(long, vocabulary)[0] > 1000


def test_language_of_large_alphabets():
    draw = np.random.default_rng(2)
    texts = ["".join(map(chr, draw.integers(0x4E00, 0x9F00, 300))) for _ in range(40)]
    letters = language.is_letter()
    together = language.bundles(texts, letters)
    assert all((language.bundles([t], letters)[0] == v).all() for t, v in zip(texts, together))


def test_one_training_row_for_each_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.labelled(docs, labels, 5).count() <= 2


def test_near_copies_keep_their_blocks(spark):
    def near(i, host):
        blocks = [[f"b{k}w{j}" for j in range(40)] for k in range(6)]
        blocks[i % 6][i // 6 % 40] = f"edit{i}"
        return f"<body><nav>x</nav><article><h1>Heading</h1>{''.join(f'<p>{chr(32).join(b)}</p>' for b in blocks)}</article></body>"

    def own(i):
        return f"<body><article><h1>T{i}</h1><p>{' '.join(f'q{i}x{j}' for j in range(50))}</p><p>Strip on all pages</p></article></body>"

    rows = [(n * 10_000 + i, f"http://near{n}.org/{i}", near(i, n)) for n in (8, 40, 200) for i in range(n)]
    rows += [(i, "http://own.org/", own(i)) for i in range(6)]
    found = {r.page_id: r.text.split("\n") for r in html_text.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(len(lines) == (7 if page >= 6 else 2) for page, lines in found.items())


@pytest.mark.parametrize("html", ["<div>" * 8000 + "x", "<article>a b</article>" * 8000, "<a href=x " * 10_000, "<a title=\"x' " * 10_000, "<ul><li>" * 5000, "</b>" * 20_000])
def test_odd_pages_take_little_time(html):
    import time

    began = time.process_time()
    html_text.Page(html_text.parse(html))
    assert time.process_time() - began < 2
