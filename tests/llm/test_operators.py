"""Each operator against a brute-force version, an exact round trip or known answers, with nulls, empties, ties and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conspectus.llm import bpe, common, components, decontaminate, html_extract, language_id, licenses, merkle, minhash, simple8b, substring_dedup, token_files, url_filter

WORDS = [f"w{k}" for k in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base, passage = prose(1, 120), prose(2, 64)
    near = base.split()
    near[60] = "changed"
    rows = [(0, base), (1, base), (2, " ".join(near)), (3, prose(3, 90)), (4, None), (5, ""), (6, "two words"), (7, "Two  words"), (8, f"{prose(4, 40)} {passage}"), (9, f"{prose(5, 30)}\n{prose(6, 5)} {passage} {prose(7, 9)}"), (10, "é" * 5000), (3, prose(3, 90)), (None, base)]
    return spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, key string")


def empty(docs):
    return docs.where(F.lit(False))


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(docs):
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == (None if r.doc_id is None else find(r.doc_id))
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    sizes = {i: len(s) for i, s in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in found)
    assert minhash.near_duplicates(empty(docs)).count() == 0
    assert minhash.drop_near_duplicates(docs).columns == docs.columns


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 180)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(found[k] == 0 for k in range(41)) and all(found[k] == 100 for k in range(100, 180)) and found[201] == 200
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_few_edges_take_few_jobs(spark, monkeypatch):
    """Rounds over few edges are single plans; both ways give the same components."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 130)], "a bigint, b bigint")
    found, jobs = {}, {}
    for few in (components.FEW_EDGES, 0):
        monkeypatch.setattr(components, "FEW_EDGES", few)
        spark.sparkContext.setJobGroup(f"components of {few}", "")
        found[few] = sorted(tuple(r) for r in components.components(edges).collect())
        jobs[few] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components of {few}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    (few, one), (_, other) = found.items()
    assert one == other and {c for _, c in one} == {0}
    assert jobs[few] <= 0.75 * jobs[0]


def test_components_of_few_edges_take_few_tasks(spark, request):
    """However many partitions shuffles have, a round over few edges deals them to few tasks, and leaves few files."""
    for key, value in (("spark.sql.shuffle.partitions", "64"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        before = spark.conf.get(key)
        request.addfinalizer(lambda key=key, before=before: spark.conf.set(key, before))
        spark.conf.set(key, value)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a bigint, b bigint")
    spark.sparkContext.setJobGroup("tasks of components", "")
    found = components.components(edges)
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(31)}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {k for j in tracker.getJobIdsForGroup("tasks of components") for k in tracker.getJobInfo(j).stageIds}
    tasks = sorted(x.numTasks for x in map(tracker.getStageInfo, stages) if x)
    assert found.rdd.getNumPartitions() <= 2 * common.LEAST_PARTS
    assert sum(n >= 64 for n in tasks) <= 2, tasks


def test_divided_buckets_are_compared_exactly():
    """Members of one bucket in blocks: every link that joins components, none below the limit, each joined once."""
    r = np.random.default_rng(4)
    b = minhash.DOCUMENTS
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    sets = []
    for _ in range(60):
        x = base.copy()
        c = int(r.integers(0, 9))
        x[r.choice(60, c, replace=False)] = r.integers(0, 2**63, c)
        sets.append(np.unique(x))
    for blocks, across in ((1, False), (2, True)):
        rows = [((7, 0, blocks - 1), k % blocks, k, k, -1, [7, 100 + k], x.tobytes()) for k, x in enumerate(sets)]
        links = list(minhash.links_of(rows, across, b))
        near = {(i, j) for i in range(60) for j in range(i + 1, 60) if (not across or i % 2 != j % 2) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}

        def parts(edges):
            root = list(range(60))
            for i, j in edges:
                p, q = root[i], root[j]
                root = [min(p, q) if x in (p, q) else x for x in root]
            return root

        assert set(links) <= near and parts(links) == parts(near) and len(links) == 60 - len(set(parts(near))) and 5 < len(set(parts(near))) < 55
    assert not list(minhash.links_of([((7, 0, 0), 0, k, k, -1, [3, 7], sets[0].tobytes()) for k in range(3)], False, b))  # they meet in an earlier bucket
    assert not list(minhash.links_of([((7, 0, 0), 0, k, k, 0, [7, 8], sets[0].tobytes()) for k in range(2)], False, b))  # the pivot has been compared


def test_near_duplicates_of_a_wide_group(spark):
    """A large group whose members are at both sides of the limit, so that buckets stay divided, against brute force."""
    r = random.Random(77)
    base = prose(900, 70).split()
    rows = []
    for k in range(240):
        w = list(base)
        for at in r.sample(range(70), r.choice([0, 1, 2, 2, 3])):
            w[at] = f"e{r.randint(0, 9)}"
        rows.append((k, " ".join(w)))
    sets, root = [shingles(t) for _, t in rows], list(range(240))
    for i in range(240):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and root[i] != root[j]:
                p, q = sorted((root[i], root[j]))
                root = [p if x == q else x for x in root]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {x.doc_id: x.component_id for x in found} == dict(enumerate(root)) and 20 < len(set(root)) < 200


def test_band_settings():
    assert minhash.DOCUMENTS.miss(0.85) < 2e-6


def test_stage_takes_pairs_from_eighty_on(spark):
    import corpus_pipeline

    assert minhash.STAGE.miss(0.8) < 2e-6
    rows = []
    for k in range(30):
        w = prose(500 + k, 104).split()  # 100 shingles; 2 words changed: 90 of 110, or 0.818
        x = list(w)
        x[30], x[70] = "changed", "other"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(x))]
    left = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(r.doc_id for r in left.collect()) == list(range(0, 60, 2))


def test_repeated_passages(docs):
    found = {(r.doc_id, r.kept_doc_id): r for r in substring_dedup.repeated_passages(docs).collect()}
    assert found[9, 8].n_words == 64 and found[9, 8].start_word == 35 and found[9, 8].kept_start_word == 40
    assert (1, 0) in found and (2, 0) in found and not any(i in (3, 6, 7, 10) for i, _ in found)
    cut = substring_dedup.cut_passages(docs, substring_dedup.repeated_passages(docs))
    texts = {r.doc_id: r.text for r in cut.where("doc_id IS NOT NULL").collect()}
    assert cut.columns == docs.columns and 1 not in texts and texts[8].endswith(prose(2, 64)) and prose(2, 64) not in texts[9]
    assert len(texts[9].split()) == 44 and texts[4] is None and texts[5] == ""
    assert substring_dedup.repeated_passages(empty(docs)).count() == 0


def test_repeats_of_frequent_lines(spark):
    line = prose(60, 30)
    rows = [(k, f"{prose(100 + k, 40)} {line} {prose(200 + k // 2, 22)} {prose(300 + k, 30)}") for k in range(40)]
    rows += [(50, f"{line} {prose(400, 30)} {line} {prose(401, 30)}"), (51, f"{prose(402, 9)} {line} {prose(401, 30)}"), (52, f"{prose(403, 9)} {line} {prose(401, 30)}")]
    held, want = {}, set()
    for i, text in rows:
        w = text.split()
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        want |= {(i, k) for k, x in enumerate(runs) if held.get(x, i) != i}
        for x in runs:
            held.setdefault(x, i)
    found = set()
    for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        found |= {(r.doc_id, k) for k in range(r.start_word, r.start_word + r.n_words - 49)}
    assert len({i for i, _ in want}) == 22 and want == found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_between_two_frequent_runs(spark, seed):
    """Two runs of 30 words, each frequent by itself in 20 earlier documents; 30 documents hold both with one differing word, or two inserted ones, between them."""
    one, two = prose(7000 + seed, 30), prose(7100 + seed, 30)
    rows = [(k, f"{prose(8000 + 100 * seed + k, 40)} {(one, two)[k % 2]} {prose(8500 + 100 * seed + k, 40)}") for k in range(40)]
    between = lambda k: f"edit{k}" if k % 3 else f"edit{k} more{k}"
    rows += [(100 + k, f"{prose(9000 + 100 * seed + k, 25)} {one} {between(k)} {two} {prose(9500 + 100 * seed + k, 25)}") for k in range(30)]
    passages = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = passages.collect()
    assert {r.doc_id for r in found if r.n_words >= 60 and r.start_word <= 25} == set(range(101, 130)) and not any(r.doc_id < 100 for r in found)
    clusters = substring_dedup.passage_clusters(passages).collect()
    assert {r.cluster_id for r in clusters} == {100} and all(r.n_links >= 1 for r in clusters)


def test_passages_in_far_cells_and_parts():
    """Passages beside and across the borders of cells, several on one diagonal, are all found; bands are the same in parts of any size."""
    r = np.random.default_rng(11)
    fresh = lambda n: r.integers(0, 2**32, n, dtype=np.uint32)
    a, b = fresh(5000), fresh(5000)
    for at in (0, 460, 1020, 2030, 4950):
        b[at : at + 50] = a[at : at + 50]
    places = [(0, c) for c in (0, 1, 2, 3, 4, 9)]
    assert substring_dedup.shared_passages(a, b, places) == [(k, k + 50, k) for k in (0, 460, 1020, 2030, 4950)]
    copy = np.concatenate([fresh(3), a])
    assert substring_dedup.shared_passages(a, copy, [(-3, 4)]) == [(0, 5000, 3)]
    text = " ".join(f"w{k}" for k in r.integers(0, 3000, 4000))
    raw, offs = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    whole = substring_dedup.bands_of(raw, offs)
    for part in (64, 1 << 10):
        assert {*zip(*(c.tolist() for c in substring_dedup.bands_of(raw, offs, part=part)), strict=True)} == {*zip(*(c.tolist() for c in whole), strict=True)}


def test_passages_of_far_ids_and_namesakes(spark):
    """Ids that leave no room for places beside them, and a row that shares its id with another."""
    passage = prose(70, 64)
    far = 2**62
    rows = [(-far, f"{prose(71, 30)} {passage}"), (far, f"{passage} {prose(72, 30)}"), (far, prose(73, 200)), (5, f"{prose(74, 9)} {passage}"), (None, passage)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id bigint, text string, cut_id int, cut_spans int")
    passages = substring_dedup.repeated_passages(df)
    assert {(r.doc_id, r.start_word, r.n_words, r.kept_doc_id, r.kept_start_word) for r in passages.collect()} >= {(5, 9, 64, -far, 30), (far, 0, 64, -far, 30)}
    left = substring_dedup.cut_passages(df, passages)
    assert left.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted((str(i), t.replace(passage, "")) if i in (far, 5) else (str(i), t) for i, t in rows)


def test_bands_of_edited_paragraphs():
    r = random.Random(70)
    met = 0
    for k in range(400):
        n = r.choice((50, 60, 80, 98))
        w = [f"p{k}-{i}" for i in range(n)]
        x, at = list(w), r.randrange(n)
        x[at : at + r.choice((0, 1))] = ["new"] * r.choice((1, 1, 2)) if n > 60 else ["new"]
        if n > 90:
            x[(at + n // 2) % n] = "other"
        a, b = (set(shingles(" ".join(t))) for t in (w, x))
        if len(a & b) < 0.8 * len(a | b):
            continue
        raw = [f"{prose(k, 9)} {' '.join(w)}".encode(), f"{prose(-k, 30)} {' '.join(x)} end".encode()]
        key, row, _ = substring_dedup.bands_of(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), len(raw[0] + raw[1])]))
        assert set(key[row == 0]) & set(key[row == 1])
        met += 1
    assert met > 250


def test_passages_with_edits():
    r = np.random.default_rng(3)
    fresh = lambda n: r.integers(0, 2**32, n, dtype=np.uint32)
    for n in (50, 60, 80, 98):
        for _ in range(50):
            p, at = fresh(n), int(r.integers(15, n - 15))
            longer = np.concatenate([p[:at], fresh(1), p[at:]])
            for x, y in ((p, longer), (longer, p)):
                a, b = np.concatenate([fresh(7), x, fresh(9)]), np.concatenate([fresh(20), y, fresh(5)])
                shift = [(7 - 20 if at * 2 >= n else 7 - 20 + len(x) - len(y), 0)]
                assert substring_dedup.shared_passages(a, b, shift) == [(7, 7 + len(x), 20)]
    p = fresh(240)
    q = p.copy()
    q[[40, 200]] = fresh(2)
    q[80:160:6] = fresh(14)  # a densely edited part between two near copies
    assert substring_dedup.shared_passages(p, q, [(0, 0)]) == [(0, 80, 0), (159, 240, 159)]


def test_merkle(docs):
    own = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text or "") for r in own.collect()))
    found = {r.doc_id: r for r in merkle.edited_fingerprints(own).collect()}
    prints = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = found[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    assert found[0].near_next == 1.0 and found[3].near_edited > found[3].near_next
    assert merkle.edited_fingerprints(empty(docs)).count() == 0


def test_merkle_likeness_and_uneven_ids(spark):
    """Texts, digests and both likenesses against a second version; ids that lie far apart, without an id, and repeated."""
    r = random.Random(8)
    ids = [*range(900), 2**62, -(2**62), *range(10**6, 10**6 + 900), *range(10**12, 10**12 + 30 * 7, 7)]
    rows = [(i, "\n".join(". ".join(prose(r.randrange(40), r.randrange(1, 20)) for _ in range(2)) for _ in range(r.randrange(3)))) for i in ids]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows] + [(None, "no id", 0)] * 2, "doc_id bigint, text string, start int")
    place, firsts = merkle.buckets(df.select(F.col("doc_id").alias("id")).where("id IS NOT NULL"))
    sizes = [x["count"] for x in place(df.select(F.col("doc_id").alias("id")).where("id IS NOT NULL")).groupBy("start").count().collect()]
    assert max(sizes) <= 4 * merkle.BUCKET_ROWS and len(sizes) == firsts.count()

    def clauses(text):
        out = set()
        for part in re.split(r"(?<=\n\n)(?!\n)", text):
            for line in re.split(r"(?<=\n)", part):
                out |= set(re.findall(r"\s*(?:\S*[^\s.!?]\s+){0,7}\S+\s*|\s+", line))
        return out

    near = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    found = {}
    for x in merkle.edited_fingerprints(df).collect():
        found.setdefault(x.doc_id, []).append(x)
    rows.sort()
    for k, (i, text) in enumerate(rows):
        after, cut = rows[(k + 1) % len(rows)][1], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        (x,) = found[i]
        assert x.n_chars == len(text) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(x.near_edited - near(clauses(text), clauses(edited))) < 1e-9 and abs(x.near_next - near(clauses(text), clauses(after))) < 1e-9
    assert len(found[None]) == 2 and found[None][0] == found[None][1] and found[None][0].near_next == 0


def test_merkle_locates_edits(spark):
    a = "One.\nTwo.\n\nThree.\nFour.\n\nFive."
    b = a.replace("Four", "Fourth")
    rows = spark.createDataFrame([(0, a), (1, b)], "doc_id int, text string")
    x, y = (r.fingerprint for r in merkle.fingerprints(rows).orderBy("doc_id").collect())
    got = spark.createDataFrame([(x, y)], "a string, b string").select(merkle.differing_branches(F.col("a"), F.col("b")).alias("d"), merkle.differing_branches(F.col("a"), F.col("a")).alias("e")).first()
    assert [tuple(d) for d in got.d] == [(1, 1)] and got.e == []


def test_bpe_equals_tiktoken(docs):
    import public_tokenizers as P
    import tiktoken

    tokens = bpe.read_ranks(P.path(bpe.NAME))
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    coder = bpe.Coder(P.path(bpe.NAME), P.PATTERN, 50)
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(" \t\n\r\x85\xa0abcXYZ'sélÉ123!?.,日本한🙂") for _ in range(r.randint(0, 30)))
        ids = want.encode_ordinary(text)
        assert coder.encode(text) == ",".join(map(str, ids)) and coder.decode(np.array(ids, int)) == text.encode()
    for row in bpe.encode_bpe(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert row.ids == want.encode_ordinary(row.text or "") and row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert bpe.encode_bpe(empty(docs)).count() == 0


def test_bpe_by_another_pattern():
    """A pattern that cuts elsewhere: white space joined to the word before it, digits one by one, other characters left out."""
    import public_tokenizers as P
    import tiktoken

    assert bpe.SPLIT == P.PATTERN
    split = r"\p{L}+\s?|\p{N}|[^\s\p{L}\p{N}]{1,2}"
    tokens = bpe.read_ranks(P.path(bpe.NAME))
    want = tiktoken.Encoding("own", pat_str=split, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    coder = bpe.Coder(P.path(bpe.NAME), split, 50)
    r = random.Random(4)
    for _ in range(500):
        text = "".join(r.choice(" \t\nabcXYZ'sé123!?.,日") for _ in range(r.randint(0, 30)))
        assert coder.encode(text) == ",".join(map(str, want.encode_ordinary(text)))


def test_language_id(spark):
    langs = {"xx": "abcdef", "yy": "mnopqr"}
    r = random.Random(5)
    rows = [(k, " ".join("".join(r.choice(langs[x]) for _ in range(5)) for _ in range(30)), x, "s") for k in range(90) for x in [r.choice("xy") * 2]]
    rows += [(1000, None, "xx", "s"), (1001, "12 34", None, "s"), (1002, "", "yy", "s")]
    found = {x.doc_id: x for x in language_id.language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), steps=60).collect()}
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in found)
    assert all(found[k].lang_pred == x for k, _, x, _ in rows[:90])
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (1000, 1001, 1002))


def test_language_sample_reads_all_of_a_text_and_all_languages(spark):
    """The sample's pieces come from whole texts, and a rare language has its share."""
    r = random.Random(6)
    word = lambda letters: "".join(r.choice(letters) for _ in range(5))
    rows = [(k, f"{'12 ' * 700}{' '.join(word('abcdef') for _ in range(3000))}", "xx") for k in range(40)]
    rows += [(100 + k, " ".join(word("mnopqr") for _ in range(20)), "yy") for k in range(4)] + [(k, "zz zz", "xx") for k in (500, 500)] + [(None, "q", "xx")]
    df = spark.createDataFrame([(*x, 0, 0) for x in rows], "doc_id bigint, text string, lang string, h int, pieces int")
    net = language_id.fit(df, sample_rows=20, steps=80)
    assert net.langs == ["xx", "yy"]
    found = {x.doc_id: x.lang_pred for x in language_id.identify(df, net).collect()}
    assert all(found[100 + k] == "yy" for k in range(4)) and all(found[k] == "xx" for k in range(40))
    assert language_id.language_id(df.where("doc_id < 0"), steps=2).count() == 0
    left = language_id.keep_known(df.unionAll(df.limit(1)), net, 0.4)
    assert left.columns == df.columns and left.count() >= 44


def test_gradients():
    net = language_id.Network.fresh(["a", "b", "c"], 3, 1)
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    codes, mask, label = rng.integers(0, 256, (5, 4)), np.ones((5, 4)), np.array([0, 1, 2, 1])
    _, g = net.gradients(codes, mask, label)
    for k in g:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.w[k][i] += 1e-3
        up, _ = net.gradients(codes, mask, label)
        net.w[k][i] -= 2e-3
        down, _ = net.gradients(codes, mask, label)
        net.w[k][i] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][i]) < 1e-3 * max(1, abs(g[k][i]))


BODY = "<p>" + "This is a sentence of the article, with some words, and more to read. " * 3 + "</p>"
TEXT = " ".join(("This is a sentence of the article, with some words, and more to read. " * 3).split())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><body><header><h1>Site</h1></header><div id=sidebar><p>{'side, ' * 30}</p></div><main><h2>T &amp; U</h2>{BODY}<aside>x</aside>{BODY}</main><footer>f</footer></body></html>", f"T & U {TEXT} {TEXT}"),
        (f"<body><article><h1>Head</h1><p><b>Open{BODY}<div class='comments'>{BODY}</div><form><p>Name, mail</p></form></article><script>x</script>", f"Head Open {TEXT}"),
        (f"<body><div class=menu><a href=x>x</a></div><div class=content>{BODY}<p>Short.</p></div><div class='comment-list'>{BODY * 5}</div>", f"{TEXT} Short."),
        (None, ""), ("", ""), ("just  text", "just text"), ("<nav>x</nav>", ""), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_html(page, text):
    assert html_extract.extract(page) == text


PROBES = [
    (f"<body><article><h1>H</h1><p data-x=it's>{BODY}</article><footer>f</footer>", f"H {TEXT}"),
    (f'<body><div class=content><p title="foo>First words.{BODY}<a href="x">y</a>{BODY}</div>', f"First words. {TEXT} y {TEXT}"),
    (f'<div class="content"><p title="a > b" data-y=\'<p class="z">\'>{BODY}</div>', TEXT),
    (f"<body><div class='cookie-recipe'><h2>Cookies</h2>{BODY}</div><div class=cookie-banner><p>We use cookies, as all do.</p></div>", f"Cookies {TEXT}"),
    (f"<article><section class='menu-history'>{BODY}</section>{BODY}<div class='main-menu'><p>Home, news, more</p></div></article>", f"{TEXT} {TEXT}"),
    (f"<article><div class='article-header'><h1>Head</h1></div><p>a\0b</p>{BODY}<div class=sharePanel><p>Share this, please</p></div></article>", f"Head a\0b {TEXT}"),
    (f"<main><div class=content>{BODY}{BODY}</div><div>{'<a href=x>one link, and another</a> ' * 40}</div></main>", f"{TEXT} {TEXT}"),
    (f"<!--<p>x --><article>{BODY}<!-- <p>y</p> --!>{BODY}</article>", f"{TEXT} {TEXT}"),
    (f"<article>{BODY}<p>1 < 2 &lt; 3 &amp;amp; &#x41;&nbsp;&copy;</p></article>", f"{TEXT} 1 < 2 < 3 &amp; A ©"),
    (f"<article>{BODY}<p>cut <b", f"{TEXT} cut"),
]


@pytest.mark.parametrize("k", range(len(PROBES)))
def test_html_by_the_rules(k):
    page, text = PROBES[k]
    assert html_extract.extract(page) == text


TOPICS = "section.advertising-law section.newsletter-history p.comment-theory section.subscripts div.sidebar-history div.footer-notes div.cookie-recipes section.consent-theory div.login-history p.widgetry-essay section.navigation-at-sea div.social-contract section.related-rates".split()
PARTS = "div.ad-slot div.ads div.ad_unit div.advert-box section.newsletter-box div.comment-list div#comments div.sidebar-primary div#side div.footer-links div.cookie-notice div.newsletter-signup-form div.social-share-buttons div.sponsor-zone div.breadcrumb-trail div.widget-area div.login-form-wrapper div.popup-overlay div.navbar-fixed div.side-panel div.adLeaderboard div.related-posts".split()


@pytest.mark.parametrize("name", TOPICS)
def test_html_keeps_what_an_article_is_about(name):
    tag, mark, value = re.fullmatch(r"(\w+)([.#])(.*)", name).groups()
    part = f"<{tag} {'class' if mark == '.' else 'id'}='{value}'>{'' if tag == 'p' else '<p>'}A topic, said in words.</{tag}>"
    assert html_extract.extract(f"<body><article>{BODY}{part}{BODY}</article></body>") == f"{TEXT} A topic, said in words. {TEXT}"


@pytest.mark.parametrize("name", PARTS)
def test_html_drops_parts_of_pages(name):
    tag, mark, value = re.fullmatch(r"(\w+)([.#])(.*)", name).groups()
    part = f"<{tag} {'class' if mark == '.' else 'id'}='{value}'><p>Buy now, and read on, for less.</p></{tag}>"
    assert html_extract.extract(f"<body><article>{BODY}{part}{BODY}</article></body>") == f"{TEXT} {TEXT}"


def test_html_named_main_part_and_sibling_articles():
    short = "".join(f"<p>{c}</p>" for c in "abcdef")
    for main in ("<main>{}</main>", "<div id=main>{}</div>", "<div role='main'>{}</div>"):
        for side in ("div id=side", "div id=extra", "section"):
            page = f"<body>{main.format(short)}<{side}>{BODY * 3}</{side.split()[0]}></body>"
            assert html_extract.extract(page) == "a b c d e f", page
    assert html_extract.extract(f"<body><div><article>{BODY * 4}</article><article><h2>Two</h2><p>A second one, and a shorter one.</p></article></div></body>") == f"{' '.join([TEXT] * 4)} Two A second one, and a shorter one."
    assert html_extract.extract(f"<body><main><ul><li><a href=x>menu of links</a></ul></main><div><p>{TEXT}</p></div></body>") == TEXT
    assert html_extract.extract(f"<body><div class=left-side>{BODY}</div><div class=menu-box>menu</div></body>") == TEXT


def test_html_takes_linear_time():
    import time

    took = []
    for n in (4000, 32000):
        began = time.process_time()
        for page in ("<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, '<p title="foo>' * n, "<a x='>" * n + '"', "<" * n, "<!--" * n, "<li>" * n + "</p>" * n):
            html_extract.extract(page)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]


def test_html_of_generated_pages():
    """Articles among page parts, in several layouts, against the text that was put in."""
    import html as H

    r = random.Random(31)
    sentence = lambda: " ".join(r.choice(["one", "two,", "thrée", "a & b", "x < y", "“so”", "long-ish", "words,"]) for _ in range(r.randint(8, 30))) + "."
    parts = ["<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>", "<div class='sidebar left'><p>About us, and more, and so on, for long enough to count.</p></div>", "<footer><p>© 2020, all of us, everywhere.</p></footer>", "<div id=newsletter-signup><form><p>Mail, please, and your name as well.</p></form></div>", "<aside><p>Related, but not the same, and long enough to count for something.</p></aside>", "<script>var a = '<p>no</p>';</script>", "<div class=advert-box><p>Buy, buy, buy this now, it is cheap, and good, and new.</p></div>", "<section id=comments><p>First! I think so, too, and more, and more, and more of it.</p></section>"]
    for _ in range(150):
        blocks = [sentence() for _ in range(r.randint(3, 9))]
        inner = "".join(f"<p>{H.escape(b) if r.random() < 0.7 else H.escape(b).replace(' ', chr(10) + '  ', 2)}" + r.choice(["</p>", ""]) for b in blocks)
        around = [r.choice(parts) for _ in range(r.randint(0, 5))]
        cut = r.randint(0, len(around))
        frame = r.choice(["<article>{}</article>", "<div class=post-content>{}</div>", "<main><div>{}</div></main>", "<div id=wrap><div class=entry>{}</div></div>"])
        page = f"<html><head><title>t</title></head><body>{''.join(around[:cut])}{frame.format(inner)}{''.join(around[cut:])}</body></html>"
        assert html_extract.extract(page) == " ".join(blocks), page


def test_extract_pages(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "t"), (1, "u", f"<article>{BODY}</article>", "t"), (2, None, None, "t"), (None, "v", "", None), (3, "w", "<article>" + BODY * 3000 + "</article>", "t")]
    pages = spark.createDataFrame([(*x, 7) for x in rows], "page_id int, url string, html string, text string, n_chars int")
    found = sorted(map(tuple, html_extract.extract_pages(pages).collect()), key=str)
    long = " ".join([TEXT] * 3000)
    assert found == sorted([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (2, None, "", 0), (None, "v", "", 0), (3, "w", long, len(long))], key=str)
    assert html_extract.extract_pages(pages.where("page_id > 9")).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for k in range(60):
        n = int(rng.integers(0, 1500))
        v = (rng.integers(0, 2**63, n, dtype=np.uint64) * 2 + 1) >> rng.integers(0, 64, n).astype(np.uint64)
        if k % 3 == 0:
            v[rng.random(n) < 0.9] = 0
        words, offsets = simple8b.encode(v)
        assert (simple8b.decode(words, offsets, n) == v).all()


def test_token_files(docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(token_files.NAME))
    t.encode_special_tokens = True
    own = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    start = 0
    found = {r.doc_id: r for r in token_files.token_files(own).collect()}
    for i, text in sorted((r.doc_id, r.text or "") for r in own.collect()):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert tuple(found[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_files(docs).count() == docs.count() and token_files.token_files(empty(docs)).count() == 0


def test_pieces_equal_the_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(token_files.NAME))
    t.encode_special_tokens = True
    own = token_files.Pieces(P.path(token_files.NAME), 50)
    r = random.Random(2)
    for _ in range(3000):
        text = r.choice([" ", "\n"]).join(r.choice(["a", "Bc.", "ÉTÉ,", ".", "don't", "µ", "ß.", "12", "the..", "_.", "x!.", "\x85", "ΣΑΣ", "İx", "日.", "é"]) for _ in range(r.randint(0, 12)))
        assert own.encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_added_tokens_equal_the_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(token_files.NAME))
    own = token_files.Pieces(P.path(token_files.NAME), 50)
    assert own.encode("a <|endoftext|> b") == np.array([320, 49407, 321], "<u4").tobytes()
    r = random.Random(3)
    for _ in range(2000):
        text = "".join(r.choice(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "a", "Bc.", " ", " ", "\n", "É", "日"]) for _ in range(r.randint(0, 9)))
        assert own.encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_urls(spark):
    want = {
        "https://www.Example.com/en/1?x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.example.com/en/2#t": ("a.example.com", "/en/2", "example.com/en/", "block"),
        "http://a.example.com": ("a.example.com", "", None, "allow"),
        "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
        "http://free-bets.org/a": ("free-bets.org", "/a", None, "block"),
        "http://freebets.org/casino": ("freebets.org", "/casino", None, "block"),
        "http://free.org/casinoshow?windy": ("free.org", "/casinoshow", None, "allow"),
        "http://x.org/?q=CASINO-x": ("x.org", "/", None, "block"),
        "http://x.org/a#porn": ("x.org", "/a", None, "block"),
        "http://free.org/deal": ("free.org", "/deal", None, "allow"),
        "http://free.org/deal?win=1&win=2": ("free.org", "/deal", None, "block"),
        "http://poker.org/pokers": ("poker.org", "/pokers", None, "allow"),
        "casino-porn.com/x": ("", "", None, "block"),
        "no url": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(want)], "page_id int, url string, host string")
    found = [tuple(r)[1:] for r in url_filter.filter_urls(pages).orderBy("page_id").select("page_id", "host", "path", "rule", "verdict").collect()]
    assert found == list(want.values())
    assert url_filter.filter_urls(pages.where("page_id < 0")).count() == 0
    again = url_filter.filter_urls(pages.unionAll(pages)).where("page_id = 4")
    assert [tuple(r)[1:5] for r in again.collect()] == 2 * [("free-bets.org", "/a", None, "block")]


def test_leaks_equal_brute_force(spark):
    """Items with up to two words of twenty replaced, at any place of a text, and texts that repeat phrases, against all places."""
    r = random.Random(90)
    items = [(k, " ".join(r.choice(WORDS[:60]) for _ in range(r.choice((8, 13, 20, 40))))) for k in range(12)]
    rows = []
    for k in range(60):
        w = r.choice(items)[1].split()
        for _ in range(r.choice((0, 0, 1, 2))):
            w[r.randrange(len(w))] = "other"
        rows.append((k, f"{prose(900 + k, r.randrange(30))} {' '.join(w)} {prose(1900 + k, r.randrange(30))} {' '.join(w[:9]) * r.choice((0, 3))}"))
    want = {}
    for i, text in rows:
        t = text.split()
        for j, item in items:
            w = item.split()
            least = max(8, min(13, -(-4 * len(w) // 5)))
            best = 0
            for shift in range(1 - len(w), len(t)):
                same = [w[k] == t[k + shift] for k in range(max(0, -shift), min(len(w), len(t) - shift))]
                total, equal = np.cumsum([0, *(1 if ok else -4 for ok in same)]), np.cumsum([0, *same])
                over = np.triu(total[None, :] > total[:, None], 1)  # stretches in which over 80 % agree
                best = max(best, int((over * (equal[None, :] - equal[:, None])).max()))
            if best >= least:
                want[i, j] = best
    found = {(x.doc_id, x.item_id): x.n_same for x in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(want) >= 45 and set(found) <= set(want)
    assert len(set(want) - set(found)) <= 0.03 * len(want)  # a stretch without a seed: two changes in each eight words


def test_leaks(docs, spark, monkeypatch):
    item = prose(40, 30)
    changed = item.split()
    changed[4] = changed[17] = "other"
    bench = spark.createDataFrame([(1, item), (2, "a few words"), (3, None), (4, prose(41, 30)), (5, ""), (6, "six words that all must agree")], "item_id bigint, text string")
    rows = [(20, f"{prose(8, 50)}\n{' '.join(changed).upper()}, {prose(9, 20)}"), (21, prose(10, 60)), (22, "a few words"), (24, "not a few words"), (None, item), (23, None), (21, item), (25, "x: Six words that all must agree!"), (26, "six words that all may agree"), (27, "")]
    docs_ = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, key int, item int")
    want = {(20, 1, 50, 30, 28), (None, 1, 0, 30, 30), (21, 1, 0, 30, 30), (22, 2, 0, 3, 3), (25, 6, 1, 6, 6)}
    digest = lambda found: sorted((str(r.doc_id), r.item_id, r.first_word, r.n_words, r.n_same) for r in found.collect())
    assert digest(decontaminate.find_leaks(docs_, bench)) == sorted((str(r[0]), *r[1:]) for r in want)
    monkeypatch.setattr(decontaminate, "EXACT_KEYS", 0)
    assert digest(decontaminate.find_leaks(docs_.unionAll(docs_), bench)) == sorted((str(r[0]), *r[1:]) for r in [*want, *want])
    monkeypatch.undo()
    left = decontaminate.drop_leaks(docs_, bench)
    assert left.columns == docs_.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["21", "23", "24", "26", "27"]
    assert decontaminate.find_leaks(empty(docs), bench).count() == 0 and decontaminate.find_leaks(docs, bench.where("item_id > 9")).count() == 0
    assert decontaminate.drop_leaks(docs, bench).count() == docs.count()


def test_licenses(spark):
    rows = [(1, f"{prose(11, 60)} {licenses.TEMPLATES['mit']} {prose(12, 5)}"), (2, "x\nAll rights reserved.\ny"), (3, "we say all rights reserved. here"), (4, f"{prose(13, 30)} Released under the MIT License."), (5, None), (6, ""), (7, licenses.TEMPLATES["mit"][:200]), (4, "")]
    found = {(r.doc_id, r.license): r.containment for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {k[:2] for k in found} == {(1, "mit"), (2, "all-rights-reserved"), (3, "all-rights-reserved"), (4, "mit-notice")} and found[1, "mit"] == 1.0
    long = spark.createDataFrame([(1, "=" * 90 + "All rights reserved.", 0), (2, "Copyright 2020 Foo. All rights reserved", 0), (None, "all, rights; RESERVED", 0), (3, "all rights", 0)], "doc_id bigint, text string, x int")
    assert sorted(str(r.doc_id) for r in licenses.scan_licenses(long).collect()) == ["1", "2"]
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_licenses_of_part_of_a_template(spark):
    """Every text that holds four fifths of a template's shingles is found, however they are spread; other texts are not."""
    r = random.Random(12)
    templates = {f"t{n}": " ".join(f"{chr(97 + n % 26)}{n}w{k}" for k in range(n)) for n in (1, 3, 4, 5, 9, 11, 15, 19, 24, 60)}
    rows, want = [], set()
    for k in range(240):
        name = r.choice(list(templates))
        w = templates[name].split()
        own, cuts = [], sorted(r.sample(range(len(w)), min(len(w), r.choice((0, 1, 2)))))
        for a, b in zip([0, *cuts], [*cuts, len(w)], strict=True):
            own += [*w[max(0, a - r.choice((0, 3, 4))) : b], "x"]
        grams = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        rows.append((k, " ".join(["pre", *own, "post"])))
        have = grams(rows[-1][1].split())
        for other, text in templates.items():
            t = text.split()
            if len(t) < 5:
                hit = any(own[i : i + len(t)] == t for i in range(len(own)))
            else:
                hit = 100 * len(grams(t) & have) >= 80 * len(grams(t))
            if hit:
                want.add((k, other))
    found = {(x.doc_id, x.license) for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), templates=templates).collect()}
    assert found == want and len(want) > 60


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = prose(50, 30)
    base = prose(51, 150)
    rows = [(0, base, "en"), (1, base, "en"), (2, f"{prose(52, 80)} {item}", "en"), (3, "12 34", "en"), (4, f"{prose(53, 60)} {prose(54, 64)}", "en"), (5, f"{prose(55, 70)} {prose(54, 64)}", "en"), (6, None, None)]
    spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(found) == [0, 4, 5]
    assert found[5].decoded_sha256 == hashlib.sha256(f"{prose(55, 70)} ".encode()).hexdigest()
