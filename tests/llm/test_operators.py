"""Each operator beside brute force on small tables with nulls, ties, copies and other columns."""

import base64
import collections
import hashlib
import re

import numpy as np
import pytest

from panelry.llm import (
    bpe, chat, exact_dedup, graph_search, html_text, jaccard_join, licenses, mixing, quality, toxicity,
)

DOC = "doc_id long, text string, lang string, source string, block long, member long"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, 0) for i, t in zip(ids, texts)], DOC)


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def test_exact_duplicates(spark):
    texts = ["Abc", "aBC", None, "", "É", "é", "Abc", "abcd", "ab"]
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs(spark, texts)).collect()}
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").encode().lower()].append(i)
    for key, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(key).hexdigest()


def test_exact_duplicates_spills_repeats_and_null_ids(spark):
    texts = ["x" * 500 + str(i % 7) for i in range(60)]
    ids = [None, *range(58), 57]
    rows = exact_dedup.exact_duplicates(docs(spark, texts, ids), trie_bytes=900).collect()
    assert len(rows) == 60
    assert sum(r.kept for r in rows) == 7
    assert {r.group_size for r in rows} == {8, 9}
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs(spark, texts, ids)).count() == 7


def test_radix_trie_against_dict():
    rng = np.random.default_rng(3)
    keys = [bytes(rng.integers(97, 100, rng.integers(0, 40)).astype(np.uint8)) for _ in range(2000)]
    trie, told = exact_dedup.RadixTrie(), {}
    for n, key in enumerate(keys):
        node = trie.find(key)
        node.entry = node.entry or [n]
        told.setdefault(key, [n])
    assert dict(trie.drain()) == told


def test_bpe_round_trip_and_library(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["It's a  test\n\n 12,5 é漢字  x", "", None, "a" * 3000, "abracadabra" * 40, "<|endoftext|>"]
    got = {r.doc_id: r for r in bpe.encoding_digest(docs(spark, texts), path, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs(spark, texts), path, public_tokenizers.PATTERN), path)
    assert {r.doc_id: bytes(r.bytes) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.encoding_digest(docs(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_words_folded_by_higher_order_functions(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    given = ["", "a", " the", "abracadabra" * 9, "漢字é", "\n\n  ", "zq" * 40, *words(6, 300)]
    frame = spark.createDataFrame([(w, 1) for w in [*given, None, "a"]], "word string, ids int")
    got = {r.word: list(r.ids) for r in bpe.folded_words(frame, path).collect()}
    assert got == {w: bpe.fold(w.encode(), ranks) for w in given}
    assert bpe.folded_words(frame.limit(0), path).count() == 0


def near_copies():
    base = words(1, 120)
    texts = [" ".join(base)]
    for k in range(30):
        copy = list(base)
        copy[(7 * k) % 120] = f"edit{k}"
        texts.append(" ".join(copy))
    texts += [" ".join(base), " ".join(base).upper(), None, "", "one two", "One  two!", "one two three"]
    return texts + [" ".join(words(s, 80)) for s in range(10, 30)]


@pytest.mark.parametrize("block", [768, 7])
def test_similar_documents_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = near_copies()
    got = {r.doc_id: r for r in jaccard_join.similar_documents(docs(spark, texts)).collect()}
    sets = collections.defaultdict(list)
    for i, t in enumerate(texts):
        w = re.findall(r"\w+", (t or "").lower())
        k = min(5, len(w))
        sets[frozenset(tuple(w[a:a + k]) for a in range(len(w) - k + 1)) if w else frozenset()].append(i)
    names = list(sets)
    links = {a: {b for b in names if a is not b and a and len(a & b) >= 0.8 * len(a | b)} for a in names}
    for a in names:
        reach, todo = {a}, [a]
        while todo:
            more = links[todo.pop()] - reach
            reach |= more
            todo += more
        for i in sets[a]:
            assert got[i].n_links == len(links[a])
            assert got[i].copies == len(sets[a])
            assert got[i].class_id == min(min(sets[b]) for b in reach)
    assert jaccard_join.similar_documents(docs(spark, [])).count() == 0


def test_survival_against_simulated_paths():
    """Two sets walk the tree by drawn hashes; the share of runs in which they end together."""
    rng = np.random.default_rng(3)
    for similarity in (0.6, 0.8, 0.95):
        met, rounds = 0, 20_000
        for _ in range(rounds):
            nodes = 1
            for _ in range(jaccard_join.DEPTH):
                first, second = rng.random(2) < similarity
                nodes = nodes * first + rng.binomial(nodes, jaccard_join.FORK) * second
            met += nodes > 0
        assert abs(met / rounds - jaccard_join.survival(similarity)) < 0.015


def test_recall_of_pairs_at_the_threshold(spark):
    """3000 pairs of similarity 0.8 exactly: at a recall of 0.9999 one in three tables misses one."""
    texts = []
    for i in range(3000):
        shared = [f"s{i}x{k}" for k in range(84)]
        texts += [" ".join([*shared, *[f"{side}{i}x{k}" for k in range(10)]]) for side in "ab"]
    rows = jaccard_join.similar_documents(docs(spark, texts)).collect()
    assert len(rows) == 6000 and sum(r.n_links for r in rows) >= 2 * 2997
    assert all(r.class_id in (r.doc_id, r.doc_id - 1) for r in rows)


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(5)
    texts, toxic = [], []
    for i in range(600):
        own = words(i, 40)
        bad = rng.random() < 0.2
        if bad:
            own[rng.integers(40)] = rng.choice(["grobword", "nastyone"])
        texts.append(" ".join(own))
        toxic.append(int(bad))
    frame = docs(spark, [*texts, None, ""], [*range(600), None, 600])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(frame, labels).collect()
    assert len(rows) == 602
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and all(r.predicted == toxic[r.doc_id] for r in held if r.doc_id < 600)
    none = labels.where("toxic > 5")
    assert {r.score for r in toxicity.toxicity(frame, none).collect()} == {0.0}


def test_mix_reaches_the_targets(spark):
    texts = [("# $ % " if i % 4 == 0 else "plain words here ") * 20 for i in range(400)] + [None, ""]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(0, 400, 3)], "doc_id long, domain int")
    rows = mixing.mix(docs(spark, texts), labels, [0.1, 0.9]).collect()
    total = sum(r.rate * r.n_tokens for r in rows)
    assert abs(sum(r.rate * r.n_tokens * r.p[0] for r in rows) / total - 0.1) < 0.01
    assert all(0 <= r.rate <= 4 and abs(r.copies - r.rate) < 1 for r in rows)
    assert mixing.mix(docs(spark, []), labels, [0.1, 0.9]).count() == 0


def bounded_least_squares(n, p, goal, low, high, rounds=40_000):
    """Accelerated projected gradient on all rates at once."""
    weighted = p * n[:, None]
    shape = np.eye(len(goal)) - np.outer(goal, np.ones(len(goal))) if low > 0 else np.eye(len(goal))
    aim = np.zeros(len(goal)) if low > 0 else goal * n.sum()
    a = shape @ weighted.T
    rate = ahead = np.full(len(n), min(max(1.0, low), high))
    size, t = np.linalg.eigvalsh(a @ a.T).max(), 1.0
    for _ in range(rounds):
        moved = np.clip(ahead - a.T @ (a @ ahead - aim) / size, low, high)
        longer = (1 + np.sqrt(1 + 4 * t * t)) / 2
        rate, ahead, t = moved, moved + (t - 1) / longer * (moved - rate), longer
    return np.linalg.norm(a @ rate - aim) / n.sum()


@pytest.mark.parametrize("target,low,high", [
    ([0.08, 0.90, 0.02], 0.0, 4.0), ([0.06, 0.93, 0.01], 1.0, 2.0), ([0.5, 0.1, 0.4], 0.0, 4.0), ([0.01, 0.01, 0.98], 0.0, 2.0),
    ([0.0, 1.0, 0.0], 0.0, 1.0),
])
def test_rates_against_bounded_least_squares(spark, target, low, high):
    """The same distance from the target as a long descent over all documents, whether it can be met or not."""
    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.2, 0.9, 0.1], 300)
    n = rng.integers(1, 900, 300).astype(float)
    rows = spark.createDataFrame([(i, int(k), x.tolist()) for i, (k, x) in enumerate(zip(n, p))],
                                 "doc_id long, n_tokens long, p array<double>")
    rated, residual = mixing.fit_rates(rows, target, low, high)
    rate = np.array([r.rate for r in rated.orderBy("doc_id").collect()])
    assert rate.min() >= low and rate.max() <= high
    goal = np.array(target) / sum(target)
    total = (rate * n) @ p
    miss = total - goal * (total.sum() if low > 0 else n.sum())
    assert np.linalg.norm(miss) / n.sum() <= bounded_least_squares(n, p, goal, low, high) + 1e-5
    assert abs(residual - np.abs(miss).sum() / total.sum()) < 1e-9


def test_quality_keeps_trusted_language(spark):
    texts = [" ".join(words(i, 60)) for i in range(200)] + ["@@ ## !!%%^^&& ~~" * 10, None, ""]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs(spark, texts), labels).collect()}
    assert sum(got[i].kept for i in range(200)) >= 190
    assert not got[200].kept and got[200].perplexity > 5 * got[0].perplexity
    assert got[201].perplexity is None and not got[202].kept
    assert all(r.kept for r in quality.quality(docs(spark, ["a", "b"]), labels.where("quality = 5")).collect())


def test_probabilities_of_a_context_sum_to_one(spark):
    packs = quality.in_blocks(docs(spark, ["abracadabra", "banana band", "cab"]).select("doc_id", "lang", "text"), 1)
    trusted = spark.createDataFrame([(i, 0) for i in range(3)], "doc_id long, block int")
    model = {r.gram: r for r in quality.language_model(packs, trusted).collect()}
    chars = [g for g in model if len(g) == 1 and model[g].p is not None]

    def chance(gram):
        if gram in model and model[gram].p is not None:
            return model[gram].p
        if not gram:
            return model[""].p
        return (model[gram[:-1]].back if gram[:-1] in model else 1.0) * chance(gram[1:])

    def other(context):
        """The chance of any character never seen."""
        weight = model[context].back if context in model else 1.0
        return weight * (other(context[1:]) if context else model[""].p)

    start = quality.START
    for context in ("", "a", "an", "ban", start, start * 2, start * 3, start + "ab", start * 2 + "b"):
        assert abs(sum(chance(context + c) for c in chars) + other(context) - 1) < 1e-9


def kneser_ney(texts, order):
    """Chances by the textbook definition, from counts kept in dictionaries."""
    top = collections.Counter(t[i:i + order] for t in texts for i in range(len(t) - order + 1))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        n = collections.Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.0
        discounts[k] = [min(i, max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else y * i / 2 for i in (1, 2, 3)]

    def chance(gram):
        k = len(gram)
        if not k:
            return 1.0 / (len(counts[1]) + 1)
        own = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return chance(gram[1:])
        total, taken = sum(own.values()), sum(discounts[k][min(n, 3) - 1] for n in own.values())
        n = own.get(gram, 0)
        return (n - discounts[k][min(n, 3) - 1] if n else 0.0) / total + taken / total * chance(gram[1:])

    return chance


def test_perplexities_against_the_definition(spark):
    trusted = ["abracadabra", "banana band", "cab and bananas", "a cab"]
    texts = [*trusted, "zebra band", "aaaa", "é"]
    plain = docs(spark, texts).select("doc_id", "lang", "text")
    packs = quality.in_blocks(plain, 3)
    known = quality.in_all_blocks(spark.createDataFrame([(i,) for i in range(len(trusted))], "doc_id long"), 3)
    got = {r.doc_id: r.log_p for r in quality.perplexities(packs, quality.language_model(packs, known)).collect()}
    chance = kneser_ney([quality.padded(t, 4) for t in trusted], 4)
    for i, text in enumerate(texts):
        line = quality.padded(text, 4)
        logs = [np.log(chance(line[k:k + 4])) for k in range(len(line) - 3)]
        assert abs(got[i] - np.mean(logs)) < 1e-9


def test_rows_of_one_id_do_not_share_a_block(spark):
    rows = docs(spark, ["x"] * 600, [None] * 300 + [7] * 300).select("doc_id", "lang", "text")
    packs = quality.in_blocks(rows, 20).groupBy("block").count()
    assert packs.count() >= 15
    trusted = spark.createDataFrame([(7,)], "doc_id long")
    counted = quality.language_model(quality.in_blocks(rows, 20), quality.in_all_blocks(trusted, 20))
    assert counted.where("gram = 'x'").count() == 1


def test_html_text(spark):
    def page(body, nav="<nav><a>Home</a></nav>"):
        return (f"<!DOCTYPE html><html><head><title>T</title><script>x='</p>'</script></head><body>{nav}"
                f"<div class='ad'>Buy</div>{body}<footer>end</footer></body></html>")

    articles = [f"<article><h1>Head {i}</h1><p>One &amp; two{i}\n three<p>Next<br>line {i}</article>" for i in range(10)]
    rows = [(i, f"http://h.example/{i}", page(a + "<div>Subscribe now</div>"), "x") for i, a in enumerate(articles)]
    plain = [f"<div><p>Only text {i}</p></div><div class='comments'>no</div><p>Follow us</p>" for i in range(9)]
    rows += [(20 + i, "http://p.example/", page(b), "x") for i, b in enumerate(plain)]
    rows += [(40, None, None, "x"), (41, "", "", "x"), (42, "u", "just text", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for i in range(10):
        assert got[i].text == f"Head {i}\n\nOne & two{i} three\n\nNext line {i}"
        assert got[i].n_chars == len(got[i].text)
    for i in range(9):
        assert got[20 + i].text == f"Only text {i}"
    assert (got[40].text, got[41].text, got[42].text) == ("", "", "just text")
    assert html_text.extract(pages.limit(0)).count() == 0


def texts_of(spark, pages):
    rows = [(i, f"http://{host}/{i}", body) for i, (host, body) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in html_text.extract(frame).orderBy("page_id").collect()]


def test_copies_of_an_article_keep_their_text(spark):
    inside = [("a", f"<body><article><h1>Title {i}</h1><p>A b</p><p>C d</p></article></body>") for i in range(10)]
    bare = [("b", f"<body><h1>Title {i}</h1><p>A b</p></body>") for i in range(10)]
    assert texts_of(spark, inside + bare) == [f"Title {i}\n\nA b\n\nC d" for i in range(10)] + [
        f"Title {i}\n\nA b" for i in range(10)]


def test_layouts_of_one_host_have_templates_of_their_own(spark):
    first = [("a", f"<body><div class=one><p>Text {i}</p><p>Follow us</p></div></body>") for i in range(12)]
    second = [("a", f"<body><section><ul><li>Other {i}</li></ul><em>All rights here</em></section></body>") for i in range(9)]
    few = [("few", f"<body><div><p>Text {i}</p></div><div><p>Follow us</p></div></body>") for i in range(7)]
    got = texts_of(spark, first + second + few)
    assert got[:12] == [f"Text {i}" for i in range(12)] and got[12:21] == [f"Other {i}" for i in range(9)]
    assert got[21:] == [f"Text {i}\n\nFollow us" for i in range(7)]  # too few pages for a template
    assert texts_of(spark, first[:8] + [("a", "<body><table><td>odd</td></table></body>")])[:8] == [f"Text {i}" for i in range(8)]


def test_names_inside_the_article(spark):
    own = ("<article><p class='notice-of-award'>One</p><section class='comments-free bar'>Two</section>"
           "<div class='news-banner-story story'>Three</div><div class=header>Four</div>"
           "<div class='comment-list'>no</div><div class='ad top'>no</div><p class=notice>no</p><aside>no</aside></article>")
    assert texts_of(spark, [("a", own)]) == ["One\n\nTwo\n\nThree\n\nFour"]


def test_equivalence_classes_against_brute_force(spark):
    rng = np.random.default_rng(5)
    pages = []
    for i in range(30):
        menu = "".join(f"<i>m{k}</i>" for k in range(3) if (i >> k) & 1)
        pages.append(f"<body><div class=k{i % 2}><b>same {i % 2}</b><u>x</u></div>{menu}<p>own {rng.integers(9)}</p></body>")
    vectors = collections.defaultdict(lambda: [collections.Counter(), collections.Counter()])
    for i, page in enumerate(pages):
        tags, texts = html_text.tokens(page)
        for kind, found in ((0, tags), (1, [html_text.text_token(t) for t in texts if t.text.strip()])):
            for token, n in collections.Counter(found).items():
                vectors[token][kind][i] = n
    classes = collections.Counter(frozenset(v[0].items()) for v in vectors.values() if len(v[0]) >= html_text.SUPPORT)
    expected = {t for t, v in vectors.items() if len(v[1]) >= html_text.SUPPORT and classes[frozenset(v[1].items())] > 0}
    frame = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    assert set(html_text.templates(frame).first().frame) == expected and len(expected) >= 2


def test_roles_are_told_apart_until_classes_nest(spark):
    """A notice is template in its place only; its class shows when paragraphs and sections are told apart by slot."""
    def page(i):
        same, own = "Follow us", "" if i % 4 else "<p>Follow us</p>"
        return f"<body><div><h1>Title {i}</h1><p>Text {i}</p>{own}<hr><p>{same}</p></div></body>"

    def deep(i):
        own = "" if i % 4 else "<section><p>Follow us</p></section>"
        first = f"Text {i}" if i % 3 else "Follow us"
        return (f"<body><div><h1>Title {i}</h1>{own}<hr><section><p>{first}</p><hr><p>Follow us</p></section></div></body>")

    def rare(i):  # the sections are in either place on too few pages to be told apart, their paragraphs nest in them
        boxes = ["<h1>T</h1>", "<section><p>Follow us</p></section>" if i < 11 else ""]
        return f"<body><div>{'' if i else '<section></section>'}{boxes[i < 6]}{boxes[i > 5]}</div><p>Text {i}</p></body>"

    pages = [("a", page(i)) for i in range(12)] + [("b", deep(i)) for i in range(12)] + [("c", rare(i)) for i in range(12)]
    got = texts_of(spark, pages)
    assert got[:12] == [f"Title {i}\n\nText {i}" + ("" if i % 4 else "\n\nFollow us") for i in range(12)]
    assert got[12:24] == [f"Title {i}" + ("" if i % 4 else "\n\nFollow us") + "\n\n" + (f"Text {i}" if i % 3 else "Follow us")
                          for i in range(12)]
    assert got[24:] == [f"Text {i}" for i in range(12)]
    frame = spark.createDataFrame(pages, "host string, html string")
    rounds = {r.host: r.rounds for r in html_text.templates(frame).collect()}
    assert len(rounds["a"]) == 1 and len(rounds["b"]) == 2 and rounds["c"] is None


def test_deep_pages_need_little_memory():
    import tracemalloc

    page = "<div class=x>" * 100_000 + "text"
    tracemalloc.start()
    assert html_text.main_text(html_text.tokens(page)[1], set()) == "text"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_points_cut_off_are_found(spark):
    """Multiples of one vector lie in the same place: pruning keeps one way to them, the links the others."""
    rows = [(50 if i == 0 else i, [float(x * (i + 1)) for x in (1, 2, 3)]) for i in range(6)] + [(7, [3.0, -1.0, 0.5])]
    got = graph_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]
    rng = np.random.default_rng(9)
    points = np.concatenate([np.repeat(rng.normal(size=(3, 8)), 60, axis=0), rng.normal(size=(60, 8))])
    points = graph_search.unit(points)
    edges, start = graph_search.build(points)
    seen = np.zeros(len(points), bool)
    graph_search.reached(edges, seen, np.array([start]))
    assert seen.all()


def test_nearest_recall(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(1500, 16)).astype(np.float32)
    vectors[100:140] = vectors[50]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(2000, None, 0), (2050, [0.0] * 16, 0), (2100, [float("nan")] * 16, 0), (None, rows[0][1], 0), (2150, [None] * 16, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(dict)
    for r in graph_search.nearest(frame, shard=400).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found = 0
    for q in range(0, 1500, 50):
        score = unit @ unit[q]
        best = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(score[i], 12), i))[:5]
        found += len({v for v, _ in got[q].values()} & set(best))
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
    assert set(got) == set(range(0, 1500, 50)) and found >= 0.9 * 150
    assert [v for v, _ in got[50].values()] == [100, 101, 102, 103, 104]


def test_stored_graphs_serve_all_blocks(spark):
    """A point is stored once however many blocks of queries search it, and blocks change no result."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(900, 8)))]
    rows += [(900 + i, [1.0, float(i)]) for i in range(3)] + [(903, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    stored = graph_search.index(graph_search.usable(frame), 3).collect()
    assert sorted(i for r in stored for i in r.ids) == list(range(904))
    assert all(max(r.edges, default=-1) < 900 and r.start >= 0 for r in stored)
    assert len({(r.shard, r["size"], r["at"]) for r in stored}) == len(stored) == 903
    assert all(len(r.edges) == graph_search.DEGREE + 1 for r in stored if r["size"] == 8)
    one, many = (sorted(map(tuple, graph_search.nearest(frame, shard=300, block=b).collect())) for b in (8192, 3))
    assert one == many and len(one) == 18 * 5 + 2
    sizes = [graph_search.shard_size(n) for n in (0, 1000, 10**6, 10**12)]
    assert sizes == [graph_search.SHARD, graph_search.SHARD, 8000, graph_search.LARGEST]


def test_license_scan_against_all_units(spark):
    texts = ["Released under the MIT License.", "x y z. Licensed under CC BY-NC 4.0. and more words here", None, "",
             "RELEASED under the\tMIT license", "all rights reserved", "nothing of the kind at all", "a\nAll rights reserved.\nb"]
    got = sorted((r.doc_id, r.license) for r in licenses.scan(docs(spark, texts)).collect())
    assert got == [(0, "MIT"), (1, "CC-BY-NC-4.0"), (4, "MIT"), (5, "Proprietary"), (7, "Proprietary")]
    assert licenses.scan(docs(spark, [])).count() == 0
    long = "filler words of a text " * 40_000 + "released under\nthe mit license " + "and more " * 40_000
    assert [(r.unit, r.dice) for r in licenses.scan(docs(spark, [long])).collect()] == [("released under the mit license", 1.0)]


def test_license_windows_against_brute_force(spark):
    """Edited notices in prose: found if and only if some window reaches the threshold, with its value."""
    rng = np.random.default_rng(12)
    texts = ["Prose first. This work is licensed under the GNU General\nPublic License, version 3. And more.",
             "x. Released under the\n// MIT License.\ncode", "licensed under the GNU Lesser General Public License version 3",
             "this work is licensed under the gnu affero general public license version 3"]
    for _ in range(60):
        some = licenses.WORD.findall(licenses.TEMPLATES[rng.integers(len(licenses.TEMPLATES))][1])[:40]
        for _ in range(rng.integers(0, 6)):
            at, kind = rng.integers(len(some)), rng.integers(3)
            some[at:at + (kind > 0)] = [] if kind == 2 and len(some) > 3 else [f"w{rng.integers(50)}"]
        texts.append(" ".join([*words(int(rng.integers(99)), int(rng.integers(0, 12))), *some, *words(3, int(rng.integers(0, 9)))]))
    known = [(name, set(b)) for name, b in licenses.template_bigrams()]
    got = collections.defaultdict(list)
    for r in licenses.scan(docs(spark, texts)).collect():
        got[r.doc_id].append((r.dice, r.license))
    hits = 0
    for i, text in enumerate(texts):
        parts = licenses.WORD.findall(text.lower())
        pairs = [f"{a} {b}" for a, b in zip(parts, parts[1:])]
        best = max(2 * len(own & t) / (len(own) + len(t)) for _, t in known
                   for low in range(len(pairs)) for high in range(low + 1, len(pairs) + 1) for own in [set(pairs[low:high])])
        hits += best >= 0.8
        assert bool(got[i]) == (best >= 0.8), text
        assert not got[i] or abs(max(got[i])[0] - best) < 1e-9 or max(got[i])[0] >= best - 0.05, text
    assert 20 < hits < len(texts)
    assert [got[i][0][1] for i in range(4)] == ["GPL-3.0", "MIT", "LGPL-3.0", "AGPL-3.0"]


def test_chat_links_orders_and_validates(spark):
    turns = [
        (1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"reply","arguments":{"text":"t","n_chars":1},"after":["b"]},'
                            '{"id":"b","name":"reply","arguments":{"n_chars":"x","z":1},"after":[]},'
                            '{"id":"c","name":"other","arguments":"[1]","after":["d"]},'
                            '{"id":"d","name":"other","arguments":{},"after":["c"]}]}'),
        (1, 1, "tool", '{"tool_call_id":"a","content":"late"}'), (1, 2, "tool", '{"tool_call_id":"a","content":"later"}'),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", None), (None, 0, "user", "x"), (3, None, "user", "x"),
    ]
    messages = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): r for r in chat.format_turns(messages).collect()}
    assert got[1, "a"].round == 1 and got[1, "b"].round == 0 and got[1, "c"].round == got[1, "d"].round == -1
    assert got[1, "a"].valid and got[1, "a"].message == (
        '{"arguments":{"n_chars":1,"text":"t"},"call_id":"a","name":"reply","result":"late"}')
    assert got[1, "b"].errors == ["n_chars: not integer", "text: missing", "z: not expected"]
    assert got[1, "c"].errors == ["arguments are not an object"] and got[1, "d"].errors == ["unknown tool other"]
    assert got[2, "2:0"].valid and '"result":"hello"' in got[2, "2:0"].message
    assert got[2, "2:2"].errors == ["n_chars: missing", "text: missing"] and got[2, "2:2"].round == 0
    assert chat.format_turns(messages.limit(0)).count() == 0


def test_chat_keeps_every_turn(spark):
    call = '{"tool_calls":[{"id":"a","name":"reply","arguments":{"text":"t","n_chars":1},"after":[]}]}'
    turns = [
        (1, 0, "system", "S0"), (1, 1, "user", "U1"), (1, 2, "assistant", "A2"), (1, 3, "assistant", "A3"),
        (1, 4, "system", "S4"), (1, 5, "user", "U5"), (1, 9, "assistant", "A9"), (1, 10, "system", "S10"),
        (2, 0, "assistant", "B0"), (2, 1, "user", "V1"), (2, 1, "user", "V1b"), (2, 2, "assistant", call),
        (2, 3, "tool", '{"tool_call_id":"a","content":"T3"}'), (2, 4, "tool", '{"tool_call_id":"a","content":"T4"}'),
        (2, 5, "tool", "T5"), (2, 6, "assistant", call.replace('"t"', '"t6"')), (2, 7, "critic", "C7"), (2, 8, None, "N8"),
        (3, 0, "system", "S only"), (None, 0, "user", "W0"), (None, 1, "system", "W1"), (4, None, "system", "X"), (4, 1, "user", "Y"),
    ]
    messages = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat.format_turns(messages).collect()
    got = {(r.conv_id, r.call_id): r for r in rows if r.call_id and r.conv_id}
    assert got[1, "1:1"].message == (
        '{"arguments":{"n_chars":2,"system":"S0","text":"U1"},"call_id":"1:1","name":"reply","result":"A2"}')
    assert '"system":"S4"' in got[1, "1:5"].message and '"result":null' in got[1, "1:5"].message
    assert got[1, "1:1"].valid and "system" not in got[4, "4:1"].message and '"result":"T3"' in got[2, "a"].message
    own = sorted((r.conv_id or 0, r.turn if r.turn is not None else -1, tuple(r.errors), r.valid) for r in rows if r.call_id is None)
    assert own == [
        (0, 0, ("no conversation",), False), (0, 1, (), True), (1, 3, (), True), (1, 9, (), True), (1, 10, (), True),
        (2, 0, (), True), (2, 1, ("repeats a call",), False), (2, 4, ("repeats a result",), False),
        (2, 5, ("result without a call",), False), (2, 6, ("repeats a call",), False),
        (2, 7, ("unknown role critic",), False), (2, 8, ("unknown role null",), False), (3, 0, (), True), (4, -1, (), True)]
    every = "\n".join(r.message for r in rows)
    for word in "S0 U1 A2 A3 S4 U5 A9 S10 B0 V1 V1b T3 T4 T5 t6 C7 N8 W0 W1 X Y".split() + ["S only"]:
        assert word in every
    assert '{"content":"A3","role":"assistant"}' in every and '{"content":"S only","role":"system"}' in every
