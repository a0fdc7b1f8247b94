"""Every registered query of the operators on the smallest tables: against DuckDB, a library, or brute force."""

import decimal
import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    norm = lambda v: round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v
    df, result = Q.QUERIES[name](spark, SF), con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()), key=repr) == want


def test_packing(spark, texts):
    tokenizer = Tokenizer.from_file(Q.tokenizer_file("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in Q.op4_packing(spark, SF).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for i, pieces in by_doc.items():
        ids, at = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert at <= 2048
    assert padding == 0


def test_language(spark, texts):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = Q.op8_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id]))
    held = [r for r in got if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_suffixes(spark, texts):
    raw = {i: t.encode() for i, t in sorted(texts.items())}
    first = {}
    for i, t in raw.items():
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for r in Q.op9_suffix_dedup(spark, SF).collect():
        t, gone = raw[r.doc_id], np.zeros(len(raw[r.doc_id]) + 1, bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < r.doc_id:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        spans = int((gone[1:-1] & ~gone[:-2]).sum() + gone[0]) if len(t) else 0
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_byte_pairs(spark, texts):
    ranks = load_tiktoken_bpe(Q.tokenizer_file("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in Q.op10_byte_bpe(spark, SF).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pages(spark):
    html = {r.page_id: (r.url, r.html or "") for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = Q.op6_html_extraction(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(html)
    for r in got:
        assert r.url == html[r.page_id][0] and r.n_chars == len(r.text)
        assert not re.search(r"[ \t]{2}|\n\n|^\s|\s$", r.text)


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("limits", [{}, {"list_rows": 50, "block_elements": 2000}])
def test_components_are_exact(spark, width, limits):
    """Every component of a whole table against exact similarities; small limits split lists and clusters."""
    from tidemark.llm import minhash_join

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    table = docs.toArrow()
    sets = []
    for at, stop, value, edge in minhash_join.shingle_sets(table["text"].combine_chunks(), width):
        sets += [value[edge[i] : edge[i + 1]].tolist() for i in range(stop - at)]
    ids, size = table["doc_id"].to_pylist(), np.array([len(s) for s in sets])
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    least = {i: i for i in range(len(sets))}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, s in enumerate(sets):
        if s:
            both = np.bincount(np.concatenate([holders[x] for x in s]), minlength=len(sets))
            for j in np.flatnonzero(100 * both >= 80 * (size + size[i] - both)):
                a, b = root(i), root(int(j))
                if ids[a] != ids[b]:
                    least[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    want = {ids[i]: ids[root(i)] for i in range(len(ids))}
    got = {r.doc_id: r.component_id for r in minhash_join.near_duplicates(docs, width, **limits).collect()}
    assert got == want
