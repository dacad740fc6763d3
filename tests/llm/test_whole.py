"""Whole operators and the pipeline against brute force; very long texts, empty tables, nulls in any column and clashing names for each."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conspectus.llm import bpe, decontaminate, html_extract, language_id, licenses, merkle, minhash, substring_dedup, token_files, url_filter

WORDS = [f"w{k}" for k in range(400)]
CLASH = "id bigint, b bigint, key string, h string, h1 int, n int, start int, words string, first string, held string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def grams(words, n=5):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def with_clashes(df):
    """The table with columns of all the names that operators use inside."""
    for column in CLASH.split(", "):
        name, kind = column.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


OPERATORS = {
    "op1": lambda d, b: licenses.scan_licenses(d),
    "op2": lambda d, b: minhash.near_duplicates(d),
    "op3": lambda d, b: substring_dedup.passage_clusters(substring_dedup.repeated_passages(d)),
    "op4": lambda d, b: merkle.edited_fingerprints(d),
    "op5": lambda d, b: bpe.encode_bpe(d),
    "op6": lambda d, b: language_id.language_id(d, steps=5),
    "op8": lambda d, b: token_files.token_files(d),
    "op10": lambda d, b: decontaminate.find_leaks(d, b),
    "cut": lambda d, b: substring_dedup.cut_passages(d, substring_dedup.repeated_passages(d)),
    "drop copies": lambda d, b: minhash.drop_near_duplicates(d),
    "drop leaks": lambda d, b: decontaminate.drop_leaks(d, b),
}
DOCS, BENCH = "doc_id bigint, text string, lang string, source string, n_chars bigint", "item_id bigint, text string"


@pytest.fixture(scope="module")
def long_text():
    """A text of more bytes than the kernels take at once (1 MB), of 330,000 words."""
    return f"{prose(1, 330_000)} {licenses.TEMPLATES['isc']}"


@pytest.mark.parametrize("name", list(OPERATORS))
def test_long_texts_clashes_and_empties(spark, long_text, name):
    rows = [(1, long_text, "en", "s", 1), (2, f"{prose(2, 30)} {long_text}", "fr", None, None), (3, None, None, None, None), (None, "x", None, None, None), (4, "", "", "", 0), (5, prose(3, 40), "fr", "s", 1)]
    docs, bench = with_clashes(spark.createDataFrame(rows, DOCS)), with_clashes(spark.createDataFrame([(7, " ".join(long_text.split()[200_000:200_040])), (None, None)], BENCH))
    found = OPERATORS[name](docs, bench).collect()
    by = {r.doc_id: r for r in found}
    if name == "op1":
        assert {(r.doc_id, r.license, r.containment) for r in found} == {(1, "isc", 1.0), (2, "isc", 1.0)}
    elif name == "op2":
        assert len(found) == 6 and by[2].component_id == 1 and by[1].n_shingles == len(grams(long_text.lower().split())) and by[3].n_shingles == 0
    elif name == "op3":
        assert {(r.doc_id, r.start_word, r.n_words, r.kept_doc_id) for r in found} == {(2, 30, len(long_text.split()), 1)}
    elif name == "op4":
        assert len(found) == 6 and by[1].n_chars == len(long_text) and by[1].near_edited > 0.5 and by[3].fingerprint == by[4].fingerprint
    elif name == "op5":
        assert len(found) == 6 and by[1].decoded_sha256 == hashlib.sha256(long_text.encode()).hexdigest()
    elif name == "op6":
        assert len(found) == 6 and by[3].lang_pred == by[4].lang_pred == "und"
    elif name == "op8":
        assert len(found) == 6 and by[1].n_tokens > 330_000 and by[2].start == by[1].start + by[1].n_tokens
    elif name == "op10":
        assert {(r.doc_id, r.first_word, r.n_same) for r in found} == {(1, 200_000, 40), (2, 200_030, 40)}
    elif name == "cut":
        assert sorted(str(r.doc_id) for r in found) == ["1", "2", "3", "4", "5", "None"] and by[2].text.split() == prose(2, 30).split() and docs.columns == list(found[0].asDict())
    else:
        assert sorted(str(r.doc_id) for r in found) == (["1", "3", "4", "5", "None"] if name == "drop copies" else ["3", "4", "5", "None"]) and list(found[0].asDict()) == docs.columns
    none = OPERATORS[name](docs.where(F.lit(False)), bench.where(F.lit(False)))
    assert none.count() == 0


def test_pages_with_clashes(spark):
    pages = with_clashes(spark.createDataFrame([(1, "http://a.com/x", "<p>one two</p>"), (None, None, None)], "page_id bigint, url string, html string"))
    assert [r.text for r in html_extract.extract_pages(pages).orderBy("page_id").collect()] == ["", "one two"]
    assert [r.verdict for r in url_filter.filter_urls(pages).collect()] == ["allow", "allow"]


def test_passages_with_edits_are_found_in_documents(spark):
    """Passages of 50 to 110 words with a word between their first and last five replaced, put in or left out, of the Jaccard index 0.8 or more: every one is found."""
    r = random.Random(44)
    rows, want = [], set()
    for k in range(160):
        n = r.choice((50, 55, 60, 70, 80, 110))
        w = [f"p{k}x{i}" for i in range(n)]
        x, at = list(w), r.randrange(5, n - 5)
        x[at : at + r.choice((0, 1, 1))] = r.choice(([f"new{k}"], [f"new{k}"], []))
        a, b = grams(w), grams(x)
        rows += [(2 * k, f"{prose(k, r.randrange(60))} {' '.join(w)} {prose(5000 + k, 20)}"), (2 * k + 1, f"{prose(9000 + k, r.randrange(60))} {' '.join(x)} {prose(7000 + k, 9)}")]
        if len(x) >= 50 and 100 * len(a & b) >= 80 * len(a | b):
            want.add((2 * k + 1, 2 * k))
    found = {(x.doc_id, x.kept_doc_id) for x in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(want) > 110 and want <= found
    assert all(b == a - 1 for a, b in found)


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return [find(k) for k in range(n)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages over documents with copies, near copies, repeated passages, benchmark items and junk."""
    import public_tokenizers as P
    import tiktoken

    r = random.Random(77)
    items = [prose(300 + k, r.choice((20, 35))) for k in range(5)]
    passages = [prose(400 + k, 64) for k in range(4)]
    texts = [prose(1000 + k, r.randrange(60, 160)) for k in range(40)]
    for k in range(24):
        base = r.choice(texts[:40])
        kind = k % 6
        w = base.split()
        if kind == 0:
            texts.append(base)
        elif kind == 1:
            w[len(w) // 2] = "changed"
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(f"{prose(2000 + k, 50)} {r.choice(passages)} {prose(3000 + k, 30)}")
        elif kind == 3:
            texts.append(f"{prose(2100 + k, 40)} {r.choice(items)}")
        elif kind == 4:
            texts.append(r.choice(["12 34", "", None, "..."]))
        else:
            texts.append(f"{r.choice(passages)} {prose(2200 + k, 25)}")
    rows = [(k, x, "en" if k % 2 else "fr", "s", len(x or "")) for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), BENCH).coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")

    import pyarrow as pa

    net = language_id.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    lang, score = language_id.told(net, pa.array(texts, pa.string()))
    kept = [(k, x) for k, x in enumerate(texts) if lang[k] != "und" and score[k] >= corpus_pipeline.LEAST_SCORE]
    sets = [grams(x.lower().split()) for _, x in kept]
    links = [(a, b) for a in range(len(kept)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components(len(kept), links)
    kept = [x for k, x in enumerate(kept) if root[k] == k]
    held: dict = {}
    for i, x in kept:
        w = x.split()
        for k in range(len(w) - 49):
            held.setdefault(tuple(w[k : k + 50]), i)
    left = []
    for i, x in kept:
        w = x.split()
        gone = {j for k in range(len(w) - 49) if held[tuple(w[k : k + 50])] != i for j in range(k, k + 50)}
        rest = [v for j, v in enumerate(w) if j not in gone]
        if rest:
            left.append((i, rest))
    want = {}
    tokens = bpe.read_ranks(P.path(bpe.NAME))
    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={x: k for k, x in enumerate(tokens)}, special_tokens={})
    for i, w in left:
        hold = [t.split() for t in items]
        if not any(w[k : k + len(t)] == t for t in hold for k in range(len(w))):
            want[i] = w
    found = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(found) == sorted(want) and 25 < len(want) < 60
    for i, x in found.items():
        text = b"".join(tokens[k] for k in x.ids).decode()
        assert text.split() == want[i] and x.ids == encoder.encode_ordinary(text) and x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS + ", cut_id int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], BENCH).coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
