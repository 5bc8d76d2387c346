"""The stages of the pipeline, each against plain Python on its own input, and edge cases."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from spanforge.llm.byte_bpe import bpe, read_vocabulary
from spanforge.llm.simhash import fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SYLLABLES = {"aa": "ba be bi bo bu na ne".split(), "bb": "ské tro čra vy ně hr".split()}


def documents():
    rng, rows = random.Random(5), []
    for i in range(240):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(90)]
        rows.append((i, "site menu\n" + " ".join(words[:45]) + "\n" + " ".join(words[45:]), lang, f"s{i % 3}", 1))
    rows += [(300 + k, rows[k][1], rows[k][2], rows[k][3], 1) for k in range(10)]
    return rows + [(400, None, "aa", "s0", None), (401, "", "aa", "s0", 0), (402, "12 34", None, "s0", 5), (403, "ba be", None, None, 5), (404, "ba " * 40_000, "aa", "s1", 1), (404, "ba " * 40_000, "aa", "s1", 1)]


def test_stages(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing", "BPE"]
    before, inputs = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append([r.asDict() for r in before.collect()])
        out = stage(spark, before, str(tmp_path))
        if k < 4:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        before = spark.read.parquet(str(tmp_path / str(k)))
    inputs.append([r.asDict() for r in before.collect()])
    first, second, third, fourth, fifth, last = inputs

    lettered = [r for r in first if any(c.isalpha() for c in r["text"] or "")]
    assert sorted(r["doc_id"] for r in second) == sorted(r["doc_id"] for r in lettered)
    truth = {r[0]: r[2] for r in rows if r[2]}
    assert all(r["lang"] == truth.get(r["doc_id"], "aa") for r in second)

    pages, seen = Counter(r["source"] for r in second), Counter()
    for r in second:
        seen.update({(r["source"], x.strip(" ")) for x in r["text"].split("\n")})
    cut = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not x.strip(" ") or seen[r["source"], x.strip(" ")] < 3 or seen[r["source"], x.strip(" ")] <= 0.05 * pages[r["source"]]) for r in second}
    assert len(third) == len(second) and all(r["text"] == cut[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in third)
    assert "menu" in second[0]["text"] and not any("menu" in r["text"] for r in third)

    prints = [fingerprint(r["text"]) % 2**64 for r in third]
    label = list(range(len(third)))
    for _ in range(3):
        for i in range(len(third)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    groups = {}
    for i, r in enumerate(third):
        groups[label[i]] = min(groups.get(label[i], 10**9), r["doc_id"])
    assert sorted(r["doc_id"] for r in fourth) == sorted(groups.values()) and len(fourth) < len(third)

    kept = {r["doc_id"]: r for r in fourth}
    assert all({**r} == kept[r["doc_id"]] for r in fifth) and 0.6 * len(fourth) < len(fifth) < 1.4 * len(fourth)

    coder = bpe(read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in fifth)
    for r in last:
        assert r["round_trip"] and np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(kept[r["doc_id"]]["text"]) and r["n_tokens"] * 4 == len(r["ids"])


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def test_group_of_copies_keeps_its_text_in_one_document(spark, tmp_path):
    rng = random.Random(8)
    body = lambda: "\n".join(" ".join("".join(rng.choice(SYLLABLES["aa"]) for _ in range(3)) for _ in range(30)) for _ in range(3))
    copied = body()
    # A third of one source, and three copies in a source of less than 60 pages.
    rows = [(i, f"site menu\n{copied if i % 3 == 0 else body()}", "aa", "s0", 1) for i in range(300)]
    small = body()
    rows += [(1000 + i, f"other menu\n{small if i < 3 else body()}", "aa", "s1", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    lines = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    assert {r.doc_id: r.text for r in lines.collect()} == {r[0]: r[1].split("\n", 1)[1] for r in rows}
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, lines, str(tmp_path)).collect()}
    assert [i for i, t in kept.items() if t == copied] == [0] and [i for i, t in kept.items() if t == small] == [1000]
    assert len(kept) == 200 + 1 + 27 + 1
