"""The stages one by one against brute force, and the whole run."""

import re
import struct
from collections import defaultdict

import public_tokenizers
import sentencepiece

import __spark_entry__ as contract
import corpus_pipeline
from wordweave.llm import contamination, quality

FOLDER = "/root/testdata/sf0.01"


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "near dedup", "benchmark decontamination", "sentencepiece"
    ]
    assert contract.queries()["pipeline"] is corpus_pipeline.run


def test_every_stage(spark, small, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = small["documents"]
    columns = docs.columns
    kept = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        path = str(tmp_path / str(number))
        stage(spark, docs, FOLDER).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "quality classifier":
            scored = quality.quality(docs, small["labels"]).where("predicted = 1")
            expected = ids(scored)
            assert len(expected) < len(texts)
        elif name == "exact dedup":
            groups = defaultdict(list)
            for i, t in texts.items():
                groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
            expected = sorted(map(min, groups.values()))
        elif name == "near dedup":
            order = sorted(texts)
            roots = _components([_fingerprint(texts[i]) for i in order], order)
            expected = sorted(set(roots))
        elif name == "benchmark decontamination":
            hit = contamination.contaminated(docs, small["benchmark"])
            expected = sorted(set(texts) - set(ids(hit)))
            assert len(expected) < len(texts)
        else:
            expected = sorted(texts)
            for r in out.collect():
                assert r.decoded == texts[r.doc_id]
                coded = [i for (i,) in struct.iter_unpack("<I", r.token_ids)]
                assert coded == library.encode(r.decoded, add_bos=True, add_eos=True)
        assert ids(out) == expected, name
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs = out
        kept.append(len(expected))
    assert ids(corpus_pipeline.run(spark, FOLDER)) == expected
    assert kept == sorted(kept, reverse=True)


def test_odd_rows_through_all_stages(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() > 0
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def _fingerprint(text):
    import xxhash

    words = text.translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fps, ids):
    import numpy as np

    fps, label = np.array(fps, dtype=np.uint64), np.array(ids)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label.tolist()
        label = new
