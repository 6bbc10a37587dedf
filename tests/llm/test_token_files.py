import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from attesta.llm import packing, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, size string"
WORDS = path("word_bpe_49k.json")


def by_hand(rows, end=1):
    """Brute force: ids of whole texts one by one, in order of (no doc_id first, doc_id)."""
    bpe, start, out = Tokenizer.from_file(WORDS), 0, []
    for doc_id, text in rows:
        ids = np.array([*bpe.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("end", [1, 70_000])
def test_files_hold_all_ids_in_order(spark, docs, tmp_path, end):
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write_token_files(docs, folder, WORDS, end)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want = by_hand(rows, end)
    got = token_files.read_token_files(spark, folder)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    # files one after the other are the flat list of all ids, of the least width
    found, places, bases = [], [], (0, 0)
    for f in manifest.orderBy("part").collect():
        file = token_files.TokenFile(f"{folder}/{f.name}")
        assert (f.doc_base, f.token_base) == bases and f.id_bytes == (4 if end > 65535 else 2) == file.kind.itemsize
        bases = (bases[0] + len(file), bases[1] + file.tokens)
        for i in range(len(file)):
            found.append(zlib.crc32(file[i].astype("<u4").tobytes()))
        places += file.doc_ids(0, len(file)).to_pylist()
        with pytest.raises(IndexError):
            file[len(file)]
    assert found == [w[3] for w in want] and places == [w[0] for w in want] and manifest.count() > 1


def test_ties_repeats_and_missing_ids(spark, tmp_path):
    rows = [(None, "no id", "", "", 0, 0.0, 0, ""), (None, None, "", "", 0, 0.0, 0, "")] + [(7, "same text", "", "", 0, 0.0, 0, "")] * 40 + [(7, "other", "", "", 0, 0.0, 0, ""), (-3, "", "", "", 0, 0.0, 0, "")]
    folder = str(tmp_path / "tokens")
    token_files.write_token_files(spark.createDataFrame(rows, SCHEMA), folder, WORDS)
    got = sorted(map(tuple, token_files.read_token_files(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -3] + [7] * 41
    ends = np.cumsum([r[2] for r in got])
    assert [r[1] for r in got] == [0, *ends[:-1].tolist()] and len({r[3] for r in got[3:]}) == 2


def test_equal_rows_fill_several_files(spark, tmp_path):
    same = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'a b' AS text")
    manifest = token_files.write_token_files(same, str(tmp_path / "tokens"), WORDS)
    assert manifest.count() > 1 and manifest.agg({"documents": "max"}).first()[0] < 100_000
    assert token_files.read_token_files(spark, str(tmp_path / "tokens")).selectExpr("count(distinct start)", "sum(n_tokens)").first() == (100_000, 300_000)


def test_empty_table(spark, empty, tmp_path):
    assert token_files.write_token_files(empty, str(tmp_path / "tokens"), WORDS).count() == 0
    assert token_files.read_token_files(spark, str(tmp_path / "tokens")).count() == 0


def test_a_file_of_another_kind_is_refused(tmp_path):
    for end in ("bin", "idx"):
        (tmp_path / f"x.{end}").write_bytes(b"no index of this kind, surely not")
    with pytest.raises(ValueError):
        token_files.TokenFile(str(tmp_path / "x"))


def test_a_worker_reads_the_tokenizer_once(monkeypatch):
    made, batch = [], pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": pa.array(["some words, some", None])})
    monkeypatch.setattr(packing, "WordIds", lambda path, kind=packing.WordIds: made.append(path) or kind(path))
    packing.word_ids.cache_clear()
    first, second = ([b.to_pylist() for b in packing._pieces(WORDS, 4096, 1)(iter([batch]))] for _ in range(2))
    packing.word_ids.cache_clear()
    assert first == second and made == [WORDS]
