"""Jaccard join, repeated passages, embeddings and components against brute force."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from texts import prose, sentence

from sparkloom.llm import embedding_dedup, families, hashes, jaccard_join, queries, substring_dedup
from sparkloom.llm.components import Forest, components

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute_join(rows, percent=75):
    forest, sets = Forest(), {i: shingles(t) for i, t in rows}
    ids = [i for i in sets if i is not None]
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= percent * len(sets[x] | sets[y]):
                forest.join(x, y)
    return {i: (len(sets[i]), forest.find(i)) for i in ids}


def edited(text, places):
    w = text.split(" ")
    for p in places:
        w[p] = f"edit{p}"
    return " ".join(w)


def cases():
    base = prose(7, 10)
    rows = [(10 + i, edited(base, [i * 4])) for i in range(25)]  # a group whose members differ from each other more than from the base
    rows += [(40, base), (41, base.upper()), (42, base + " "), (43, base + " " + sentence(1)), (44, prose(8) + " " + sentence(5)), (45, prose(9) + " " + sentence(5))]
    rows += [(50, "one two"), (51, "One  two"), (52, "one two three"), (53, None), (54, ""), (55, " \n ")]
    rows += [(60 + i, " ".join(prose(20).split()[i * 3 : i * 3 + 60])) for i in range(8)]  # a chain
    return rows


@pytest.mark.parametrize("percent", [75, 90])
def test_join(make_docs, percent):
    rows = cases()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(make_docs(rows), percent=percent).collect()}
    assert found == brute_join(rows, percent)


def test_join_of_odd_rows(make_docs, odd_texts):
    rows = jaccard_join.join(make_docs(odd_texts)).collect()
    assert len(rows) == len(odd_texts)
    found = {r.doc_id: r.component_id for r in rows}
    assert found[7] == 6 and found[0] == 0 and found[1] == 1 and found[None] is None
    assert jaccard_join.join(make_docs([])).count() == 0


def test_join_on_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_jaccard_join(spark, SF).collect()}
    assert found == brute_join(docs)


def test_one_of_each(make_docs):
    rows = cases()
    docs = make_docs([*rows, (40, prose(7, 10)), (None, "alone")])
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for _, c in brute_join(rows).values()}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 3), (9, 8), (8, 9), (2, 5), (100, 7), (7, None)] + [(i, i + 1) for i in range(200, 260)]
    found = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8, 7: 7, 100: 7} | dict.fromkeys(range(200, 261), 200)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def passage_cases():
    passage = " ".join(sentence(900 + i, 13) for i in range(5))
    rows = [(i, prose(100 + i, 8) + " " + (passage + " " if i in (3, 5, 6) else "") + prose(200 + i, 6)) for i in range(8)]
    edited_passage = passage.replace(passage.split(" ")[30], "changed")
    return [*rows, (8, prose(300, 8) + "\n" + edited_passage + "\n" + prose(301)), (9, None), (10, ""), (11, sentence(1)), (12, prose(100, 8).split(". ")[0] + ". " + prose(400))], passage


def test_passages(make_docs):
    rows, passage = passage_cases()
    texts = dict(rows)
    found = substring_dedup.repeated(make_docs(rows)).collect()
    assert {r.doc_id for r in found} == {3, 5, 6, 8}
    assert {r.doc_id for r in found if not r.removed} == {3}
    for r in found:
        start = texts[r.doc_id].find(passage[:40])
        assert start <= r.start and r.stop <= start + len(passage) + 10
    assert substring_dedup.repeated(make_docs([])).count() == 0


@pytest.mark.parametrize("words", [51, 60, 90])
def test_every_passage_has_a_paragraph(words):
    """Whatever stands around a passage of whole sentences, one of its paragraphs is chosen in both texts."""
    known = hashes.WordHash()
    for seed in range(40):
        lengths, left = [], words
        while left:
            n = min(left, 3 + (seed * 7 + left * 5) % 17)
            lengths.append(n)
            left -= n
        passage = " ".join(sentence(seed * 50 + i, n) for i, n in enumerate(lengths))
        texts = [prose(seed + 1) + " " + passage + " " + prose(seed + 2), "Short. " + passage, passage]
        sets = []
        for t in texts:
            p = substring_dedup.Passages([t], known, 28, 24)
            a = t.find(passage)
            sets.append({t[x:y] for x, y in zip(p.start, p.stop, strict=True) if a <= x and y <= a + len(passage)})
        assert sets[0] & sets[1] & sets[2]


def loose(seed, n):
    """Words without an end of a sentence."""
    return " ".join(f"{chr(97 + (seed + i) % 26)}{seed}x{i * 7919 % 1009}" for i in range(n))


@pytest.mark.parametrize("words", [51, 55, 120])
def test_passages_that_no_sentence_bounds(make_docs, words):
    """A passage that begins and ends inside unpunctuated lines or long sentences has a run in all of its documents."""
    rows, passages = [], {}
    for i in range(12):
        passages[i] = loose(1000 + i, words)
        rows += [(10 * i, loose(2000 + i, 3 + 5 * i) + " " + passages[i] + " " + loose(3000 + i, 40)), (10 * i + 1, prose(i + 1) + " And " + passages[i] + " at last. " + prose(i + 50)), (10 * i + 2, passages[i])]
    texts = dict(rows)
    found = substring_dedup.repeated(make_docs(rows)).collect()
    assert {r.doc_id for r in found if r.removed} == {i for i in texts if i % 10}
    assert {r.doc_id for r in found} == set(texts)
    for r in found:
        assert not r.removed or texts[r.doc_id][r.start : r.stop] in passages[r.doc_id // 10]


def test_runs_dont_depend_on_the_batch():
    known = hashes.WordHash()
    texts = [loose(1, 300), "", "word " * 60, loose(2, 27), loose(3, 28), loose(4, 50), prose(3, 3)]
    whole = substring_dedup.Passages(texts, known, 28, 24).runs
    for i, t in enumerate(texts):
        one = substring_dedup.Passages([t], known, 28, 24).runs
        at = whole.text == i
        assert whole.start[at].tolist() == one.start.tolist() and whole.hashes[:, at].tolist() == one.hashes.tolist()
    assert {4, 5} <= set(whole.text.tolist()) and not {1, 3} & set(whole.text.tolist())


def test_passages_dont_depend_on_the_batch():
    known = hashes.WordHash()
    texts = [prose(1), "", prose(2), "x", prose(3, 3)]
    whole = substring_dedup.Passages(texts, known, 28, 24)
    for i, t in enumerate(texts):
        one = substring_dedup.Passages([t], known, 28, 24)
        at = whole.text == i
        assert whole.start[at].tolist() == one.start.tolist() and whole.stop[at].tolist() == one.stop.tolist()
        assert whole.bands()[at].tolist() == one.bands().tolist()


def test_words_are_hashed_where_they_lie():
    """Equal words (A-Z as a-z) have equal hashes wherever they lie, other words others, whatever is done at a time; none is looked up."""
    text = " ".join([prose(1), "Ab aB ba b a aa aaa É é 中文 文中 \U0001f600", "x" * 3000, prose(1).upper(), *(f"w{i} {i}w" for i in range(3000))])
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    spots = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    begins, ends = np.array(spots).T
    found = hashes.WordHash.within(codes, begins, ends)
    assert all(hashes.WordHash.within(codes, begins, ends, n).tolist() == found.tolist() for n in (1, 50, 1000))
    by_word: dict = {}
    for (a, b), h in zip(spots, found.tolist(), strict=True):
        by_word.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), text[a:b]), set()).add(h)
    assert all(len(x) == 1 for x in by_word.values()) and len(set.union(*by_word.values())) == len(by_word)
    assert not len(hashes.WordHash.within(codes, begins[:0], ends[:0]))
    known = hashes.WordHash()
    assert len(substring_dedup.Passages([text], known, 28, 24).runs.text) and not known.known


def test_a_passage_that_stays_is_not_cut(make_docs):
    """The second document has its passage from the first, in one line there, so it is no row that stays, though the third has a near copy of its line."""
    passage = loose(31, 60)
    near = edited(passage, [30])
    rows = [(1, f"{loose(32, 90)} {passage} {loose(33, 90)}"), (2, f"{loose(34, 40)}\n{passage}\n{loose(35, 40)}"), (3, f"{loose(36, 40)}\n{near}\n{loose(37, 40)}")]
    found = sorted((r.doc_id, r.removed, dict(rows)[r.doc_id][r.start : r.stop]) for r in substring_dedup.repeated(make_docs(rows)).collect())
    assert [x for x in found if x[0] < 3] == [(1, False, found[0][2]), (2, True, passage)] and found[0][2] in passage
    assert (3, True, near) in found


def test_sets_of_many_paragraphs_at_once():
    p = substring_dedup.Passages([prose(1), "", prose(2) + " " + "word " * 60 + ".", prose(3, 30)], hashes.WordHash(), 28, 24)
    at = np.arange(0, len(p.first), 2)
    items, ends = p.short_sets(at)
    assert [items[a:b].tolist() for a, b in itertools.pairwise(ends)] == [np.unique(p.shingle_set(i).astype(np.int32)).tolist() for i in at]
    assert families.all_minima(items.astype(np.int64), np.diff(ends)).tolist() == [families.minima(items[a:b].astype(np.int64)).tolist() for a, b in itertools.pairwise(ends)]
    none = at[:0]
    assert p.short_sets(none)[1].tolist() == [0] and families.all_minima(none, none).shape == (0, families.MINIMA)


def test_without_repeats(make_docs):
    rows, passage = passage_cases()
    docs = make_docs([*rows, (20, passage), (21, passage)])
    out = {r.doc_id: r for r in substring_dedup.without_repeats(docs).collect()}
    assert docs.columns == substring_dedup.without_repeats(docs).columns
    assert out[3].text == dict(rows)[3] and len(out[5].text) < len(dict(rows)[5])
    assert out[9].text is None and out[10].text == "" and out[0].text == dict(rows)[0]
    assert out[5].text.startswith(prose(105, 8)[:50]) and out[5].text.endswith(prose(205, 6)[-50:])


def test_recall_of_paragraphs_against_all_pairs(spark):
    """Of the whole small table: every pair of chosen paragraphs in two documents with a similarity of 0.75 or more lies in reported passages."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text}
    ids, found = list(texts), []
    p = substring_dedup.Passages([texts[i] for i in ids], substring_dedup.WordHash(), 28, 24)
    sets = [set(p.shingle_set(k).tolist()) for k in range(len(p.first))]
    holders: dict = {}
    for k, x in enumerate(sets):
        for item in x:
            holders.setdefault(item, []).append(k)
    common = Counter(pair for ks in holders.values() for pair in itertools.combinations(ks, 2) if p.text[pair[0]] != p.text[pair[1]])
    pairs = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    spans: dict = {}
    for r in queries.op4_substring_dedup(spark, SF).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.stop))
    for pair in pairs:
        for k in pair:
            start, stop = int(p.start[k]), int(p.stop[k])
            covered = sum(max(0, min(stop, b) - max(start, a)) for a, b in spans.get(ids[p.text[k]], []))
            found.append(covered >= 0.98 * (stop - start))
    assert len(pairs) > 50 and np.mean(found) >= 0.98, (len(pairs), np.mean(found))


def test_one_word_again_and_again(make_docs):
    """A long text of equal words has few runs, and all of it is found in another one, and a passage behind or before it too."""
    passages = substring_dedup.Passages(["word " * 20_000], substring_dedup.WordHash(), 28, 24)
    assert 19_972 / 24 < len(passages.runs.text) < 1_100
    shared = prose(77, 8)
    rows = [(1, "word " * 3000 + shared), (2, "word " * 5000 + shared + " " + prose(78)), (3, prose(79) + " " + shared + " word" * 2000)]
    spans = {}
    for r in substring_dedup.repeated(make_docs(rows)).filter("removed").collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.stop))
    assert min(a for a, _ in spans[2]) == 0 and max(b for _, b in spans[2]) >= 5 * 5000 + len(shared)
    assert sum(b - a for a, b in spans[3]) >= len(shared) + 5 * 2000 - 10


VECTORS = "vec_id long, embedding array<float>, label int, tile string"


def brute_vectors(rows, threshold=0.98):
    forest, n = Forest(), dict.fromkeys((r[0] for r in rows), 0)
    fine = [(i, np.array(v, np.float64), x) for i, v, x in rows if i is not None and x is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    for i, x, a in fine:
        for j, y, b in fine:
            if i < j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                n[i] += 1
                n[j] += 1
                forest.join(i, j)
    return {i: (n[i], forest.find(i)) for i in n if i is not None}


def test_vectors(spark):
    r = np.random.default_rng(2)
    rows, centre = [], r.standard_normal(16)
    for i in range(300):
        v = centre + 0.18 * r.standard_normal(16) if i % 3 == 0 else r.standard_normal(16)
        rows.append((i, np.float32(v * (1 + i % 5)).tolist(), i % 2))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 1), (302, rows[0][1], None), (303, None, 0), (304, [], 0), (305, [0.0] * 16, 0), (306, [float("nan")] * 16, 0), (307, [None] * 16, 0), (308, [float("inf"), *[1.0] * 15], 0), (309, [1.0, 2.0], 0), (310, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*x, "t") for x in rows], VECTORS)
    want = brute_vectors([(i, [np.float32(c) if c is not None else None for c in v] if v is not None else None, x) for i, v, x in rows])
    found = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.dedup(df, tile=40).collect()}
    assert found == want
    assert sum(n for n, _ in want.values()) > 100
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def brute_rows(rows, threshold=0.98):
    """The same of rows that may share an id: each row's links, and the smallest id that links between rows lead to."""
    found = brute_vectors([(k, v, x) for k, (_, v, x) in enumerate(rows)], threshold)
    least: dict = {}
    for k, (_, c) in found.items():
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], n, least[c]) for k, (n, c) in found.items())


def test_rows_that_share_an_id(spark):
    """One id with two vectors, in one label and in two; a class of copies under several ids; vectors up to a factor."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 1), (1, [1.0, 0.0], 1), (4, [0.01, 1.0], 1)]
    rows += [(7, [0.5, 0.5], 0), (5, [0.5, 0.5], 0), (7, [0.5, 0.5], 0), (6, [2.0, 2.0], 0), (9, [0.5, -0.5], 0), (9, [-0.5, 0.5], 0)]
    df = spark.createDataFrame([(*x, "t") for x in rows], VECTORS)
    found = embedding_dedup.dedup(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == brute_rows(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_vectors_of_any_size(spark):
    """Components whose squares are beyond doubles, or below them, and signed zeros."""
    rows = [(0, [1e200, 0.0], 0), (1, [1e-200, -0.0], 0), (2, [3.0, 1e-3], 0), (3, [1e308, 1e308], 0), (4, [1.0, 1.0], 0), (5, [5e-324, 0.0], 0), (6, [0.0, -0.0], 0), (None, [1.0, 1.0], 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(df).collect()}
    assert found == {(0, 3, 0, True), (1, 3, 0, False), (2, 3, 0, False), (5, 3, 0, False), (3, 1, 3, True), (4, 1, 3, False), (6, 0, 6, True), (None, 0, None, False)}


def test_columns_of_any_name(spark):
    """Columns called like those of the search stay as they are."""
    names = ["_id", "_of_text", "_copies", "row", "of_text", "copies", "d1", "rid", "id", "component_id", "_quality", "score"]
    rows = [(i, t, *names) for i, t in ((1, prose(1)), (1, prose(1)), (2, prose(1) + " end"), (3, prose(2)), (None, prose(3)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "3", "None"]
    assert all(r[n] == n for r in kept.collect() for n in names)
    cut = substring_dedup.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == 5 and all(r[n] == n for r in cut.collect() for n in names)


def test_bounds_hold():
    r = np.random.default_rng(4)
    for scale in (1, 1e-3):
        x = r.standard_normal((50, 32)) + scale
        x[0, 1:] = 1e-9
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = x + 0.1 * r.standard_normal(x.shape)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        may = {tuple(p) for p in embedding_dedup.possible(embedding_dedup.quantised(x), embedding_dedup.quantised(y), 0.9)}
        assert {tuple(p) for p in np.argwhere(x @ y.T >= 0.9)} <= may


def test_vectors_on_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = {r.vec_id: (r.n_links, r.component_id) for r in queries.op5_embedding_dedup(spark, SF).collect()}
    assert found == brute_vectors(rows)


def components_of(sets, percent=75):
    """Of sets by name, the smallest name that links lead to, by all overlaps at once."""
    names, items = list(sets), {}
    for s in sets.values():
        for x in s:
            items.setdefault(x, len(items))
    member = np.zeros((len(names), len(items)), np.float32)
    for i, name in enumerate(names):
        member[i, [items[x] for x in sets[name]]] = 1
    common, size = member @ member.T, member.sum(axis=1)
    forest = Forest()
    for i, j in np.argwhere(np.triu(100 * common >= percent * (size[:, None] + size - common), 1)):
        forest.join(names[i], names[j])
    return {name: forest.find(name) for name in names}


def variants(n, words, most, seed):
    """Copies of one text with 0 to `most` words changed, some changes common to many."""
    r = np.random.default_rng(seed)
    base, out = [f"b{i}" for i in range(words)], []
    for i in range(n):
        w = list(base)
        for at in r.integers(0, words, r.integers(0, most + 1)):
            w[at] = f"often{at}" if r.random() < 0.6 else f"e{i}x{at}"
        out.append(" ".join(w[: words - int(r.integers(0, 4))]))
    return out


@pytest.mark.parametrize(("words", "most"), [(60, 8), (150, 22)])
def test_join_of_a_large_family(make_docs, words, most):
    rows = list(enumerate(variants(500, words, most, words) + variants(120, words // 2, 4, 9)))
    found = {r.doc_id: r.component_id for r in jaccard_join.join(make_docs(rows)).collect()}
    want = components_of({i: shingles(t) for i, t in rows})
    assert found == want
    assert 20 < len(set(want.values())) < 560  # neither one component nor all alone


def test_a_bucket_of_2000_near_copies_loses_no_link(make_docs):
    """One paragraph in 2,100 versions: paragraphs that are similar enough are in one cluster, all pairs compared."""
    texts = [t.capitalize() + "." for t in variants(2100, 34, 5, 3)]
    rows = [(i, f"Only here {i}.\n{t}\nLast line {i}.") for i, t in enumerate(texts)]
    found = {}
    for r in substring_dedup.repeated(make_docs(rows)).collect():
        found.setdefault(r.doc_id, set()).add(r.removed)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components_of(sets)
    members = {}
    for i, c in want.items():
        members.setdefault(c, []).append(i)
    linked = [i for c in members.values() if len(c) > 1 for i in c]
    assert len(linked) > 700
    assert set(linked) <= set(found)
    for c in members.values():
        assert len(c) == 1 or all(True in found[i] for i in c if i != min(c))


def test_rows_with_one_id_keep_their_own_text(make_docs):
    passage = " ".join(sentence(700 + i, 13) for i in range(6))
    other = prose(77, 9)
    docs = make_docs([(1, prose(5) + " " + passage), (2, passage + " " + prose(6)), (2, other), (2, other), (3, None), (None, passage)])
    out = [(r.doc_id, r.text) for r in substring_dedup.without_repeats(docs).collect()]
    assert out.count((2, other)) == 2 and (3, None) in out and (None, passage) in out and (1, prose(5) + " " + passage) in out
    assert (2, prose(6)) in out and len(out) == 6


@pytest.mark.parametrize("words", [51, 70])
def test_passages_are_cut_to_their_ends(make_docs, words):
    """What stays of a copy is its own words and no other."""
    rows, own = [], {}
    for i in range(10):
        passage = loose(500 + i, words)
        rows.append((10 * i, loose(600 + i, 30 + i) + " " + passage + " " + loose(700 + i, 30)))
        own[10 * i + 1] = (loose(800 + i, 7 + i), loose(900 + i, 9))
        rows.append((10 * i + 1, own[10 * i + 1][0] + " " + passage.upper() + " " + own[10 * i + 1][1]))
    texts = dict(rows)
    out = {r.doc_id: r.text for r in substring_dedup.without_repeats(make_docs(rows)).collect()}
    assert {i: t for i, t in out.items() if i % 10 == 0} == {i: t for i, t in texts.items() if i % 10 == 0}
    assert {i: t.split() for i, t in out.items() if i % 10} == {i: (a + " " + b).split() for i, (a, b) in own.items()}


def test_repeats_in_odd_texts(make_docs, odd_texts):
    docs = make_docs([*odd_texts, (8, "word " * 20_000), (6, prose(50)), (9, prose(50))])
    rows = substring_dedup.repeated(docs).collect()
    assert {r.doc_id for r in rows if r.removed} == {7, 8, 9} and {r.doc_id for r in rows if not r.removed} == {5, 6}
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(i for (i,) in out.select("doc_id").collect() if i is not None) == [0, 1, 2, 3, 4, 5, 6, 6]
