from __future__ import annotations

import base64
import hashlib
import importlib.util
import json
import uuid
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.session import shared_folder
from tests.conftest import SF_DIR
from tests.llm import edge

SCHEMA = "page_id long, url string, html string"


def folder(spark):
    return f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"


def brute(rows):
    last: dict = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = last[h or ""]
        other = to >= 0 and to != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if other else "response", to if other else None))
    return sorted(out, key=repr)


def read_back(spark, at):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, at).collect()), key=repr)


def test_round_trip_with_copies(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html").collect()]
    rows += [(i + 1000, u, h) for i, u, h in rows[::3]] + [(5000, None, None), (5001, "u\r\nx: y", ""), (None, "a", "alone"), (None, "b", rows[0][2])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"shard": F.lit("clash"), "sha": F.lit("clash")})
    one, two = folder(spark), folder(spark)
    a = warc.write(df, one, shard_bytes=40_000, file_bytes=9_000)
    b = warc.write(df.repartition(9).orderBy(F.rand(1)), two, shard_bytes=40_000, file_bytes=9_000)
    assert a == b and len(a["files"]) > 5, "the same bytes from any order of rows"
    assert read_back(spark, one) == brute(rows)
    payload = {r.page_id: r.payload for r in warc.read(spark, one).where("record_type = 'response' and page_id is not null").collect()}
    assert all(p.decode() == (dict((x[0], x[2]) for x in rows)[i] or "") for i, p in payload.items())


def test_shards_are_even_however_ids_are_spread(spark, monkeypatch):
    """An id far out, rows without an id and one id over and over: no shard gets more than the limit and one record,
    and the order of ids holds from shard to shard."""
    monkeypatch.setattr(warc, "CELLS", 16)
    rows = [(i, "u", "x" * 100 + str(i)) for i in range(400)] + [(1 << 62, "u", "far"), (-(1 << 62), "u", "far too")]
    rows += [(None, "u", "y" * 100 + str(i)) for i in range(300)] + [(7, "u", "z" * 100 + str(i)) for i in range(300)]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("node", "cell", "low", "width", "by_id", "_n", "size", "kind", "refers")})
    at = folder(spark)
    manifest = warc.write(clash, at, shard_bytes=30_000)
    assert read_back(spark, at) == brute(rows)
    assert sum(f["records"] for f in manifest["files"]) == len(rows)
    assert max(f["records"] for f in manifest["files"]) <= 30_000 // 700 + 1 and len(manifest["files"]) > 20
    got = [i for b in warc._read(iter([pa.RecordBatch.from_pylist(manifest["files"])]), at) for i in b.column("page_id").to_pylist()]
    assert [i if i is not None else -(1 << 63) for i in got] == sorted(i if i is not None else -(1 << 63) for i in got)


def test_what_failed_attempts_left_is_removed(spark):
    from pyarrow import fs

    at = folder(spark)
    files, root = fs.FileSystem.from_uri(at)
    files.create_dir(root)
    for name in (".part-00000-0000.warc.gz.abc.tmp", "part-00099-0000.warc.gz", "notes.txt"):
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(b"left")
    manifest = warc.write(spark.createDataFrame([(1, "a", "x")], SCHEMA), at)
    assert {i.base_name for i in files.get_file_info(fs.FileSelector(root))} == {manifest["files"][0]["file"], warc.MANIFEST, "notes.txt"}


def test_records_are_in_order_and_files_are_whole(spark):
    from pyarrow import fs

    at = folder(spark)
    manifest = warc.write(spark.read.parquet(f"{SF_DIR}/pages.parquet"), at, shard_bytes=60_000, file_bytes=20_000)
    files, root = fs.FileSystem.from_uri(at)
    ids = []
    for f in manifest["files"]:
        data = files.open_input_stream(f"{root}/{f['file']}", compression=None).read()
        assert hashlib.sha256(data).hexdigest() == f["sha256"] and len(data) == f["bytes"]
        n, rest = 0, data
        while rest:
            d = zlib.decompressobj(31)
            fields = warc.parse(d.decompress(rest))
            ids.append(int(fields["WARC-Page-ID"]))
            rest, n = d.unused_data, n + 1
        assert n == f["records"]
    assert ids == sorted(ids)
    names = {i.base_name for i in files.get_file_info(fs.FileSelector(root))}
    assert names == {f["file"] for f in manifest["files"]} | {warc.MANIFEST}, "no temporary file is left"


def test_small_payloads_and_odd_tables(spark):
    rows = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "a longer one"), (4, "d", "a longer one"), (4, "d", "a longer one")]
    at = folder(spark)
    warc.write(spark.createDataFrame(rows, SCHEMA), at, min_payload=5)
    got = read_back(spark, at)
    assert [(g[0], g[3], g[4]) for g in sorted(got)] == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (4, "response", None)]
    none = folder(spark)
    assert warc.write(spark.createDataFrame([], SCHEMA), none)["files"] == [] and warc.read(spark, none).count() == 0


def test_readers_take_only_what_the_manifest_lists(spark):
    from pyarrow import fs

    at = folder(spark)
    warc.write(spark.createDataFrame([(1, "a", "x")], SCHEMA), at)
    files, root = fs.FileSystem.from_uri(at)
    with files.open_output_stream(f"{root}/.part-9.tmp") as out:
        out.write(b"half a file")
    assert warc.read(spark, at).count() == 1
    listed = json.loads(files.open_input_stream(f"{root}/{warc.MANIFEST}").read())
    assert listed["files"][0]["records"] == 1


def test_broken_records_are_noticed():
    data = warc.record(1, "u", b"payload", None)
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError, match="broken"):
        warc.parse(data.replace(b"payload", b"paYload"))


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp
    from tests.llm.test_models import brute_leaks
    from tests.llm.test_ngram_join import brute_components, brute_set
    from tests.llm.test_sharding_mixing import WORDS, brute_targets

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = spark.createDataFrame([(900_001, "123 456", "en", "src0", 7), (900_002, None, "en", "src0", 0)], docs.schema)
    step = docs.union(extra)
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "benchmark_free", "mixture", "shards"]
    language, unique, free, mixture, shards = (f for _, f in cp.STAGES)
    one = language(spark, step, SF_DIR).cache()
    assert one.columns == docs.columns and sorted(one.collect()) == sorted(docs.collect())
    two = unique(spark, one, SF_DIR).cache()
    comps = brute_components({r.doc_id: brute_set(r.text) for r in one.collect()})
    assert {r.doc_id for r in two.collect()} == set(comps.values()) and two.columns == docs.columns
    three = free(spark, two, SF_DIR).cache()
    leaks = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in two.collect()], spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect())}
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - leaks
    four = mixture(spark, three, SF_DIR).cache()
    size = lambda rows: {s: sum(len(WORDS.findall(r.text)) for r in rows if r.source == s) for s in {r.source for r in rows}}
    want, got = brute_targets(size(three.collect())), size(four.collect())
    assert four.columns == docs.columns and sum(got.values()) == pytest.approx(sum(want.values()), rel=0.05)
    five = shards(spark, four, SF_DIR).collect()
    assert len(five) == four.count() and sorted((r.shard, r.slot) for r in five) == sorted((i % 24, i // 24) for i in range(len(five)))
    assert cp.run(spark, SF_DIR).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_every_operator_has_a_query(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert edge.docs(spark).count() == len(edge.ROWS)
