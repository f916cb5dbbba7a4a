import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavault import catalogue
from stratavault.functions import binary as B, gf256, paths as P
from stratavault.operators import chunking, codec, dedup
from stratavault.params import Chunking, Coding

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark conversations events".split()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalogue.oracle_sql()[name]).df()
    got = catalogue.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).astype(str).values.tolist()))
    assert rows(got) == rows(want)


def slow_ends(data: bytes, p: Chunking) -> list[int]:
    ends, prev = [], -1
    while prev + p.minimum < len(data):
        e, stop = prev + p.minimum, min(prev + p.maximum, len(data) - 1)
        while e < stop and sum(data[e - i] * pow(257, i) for i in range(p.window)) % (1 << 23) & p.mask:
            e += 1
        ends.append(e)
        prev = e
    return ends + ([len(data) - 1] if prev < len(data) - 1 else [])


def test_variable_chunks_as_the_slow_rule():
    rng, p = np.random.default_rng(0), Chunking(64, 128, 256)
    for n in (0, 1, 63, 64, 65, 200, 1000, 1777):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert chunking.variable_ends(data, p) == slow_ends(data, p), n
    assert chunking.variable_ends(b"", p) == []


@pytest.mark.parametrize("coding", [Coding(), Coding(pair="low"), Coding(codec="crsss"), Coding(codec="caont_rs_old"), Coding(codec="aont_rs"), Coding(n=6, m=3, r=1)])
def test_any_k_shares_rebuild(spark, coding):
    secrets = [b"\0" * 5, b"a", b"x" * 31, b"y" * 64, bytes(range(256)) * 3]
    rows = spark.createDataFrame([(i, bytearray(s), len(s)) for i, s in enumerate(secrets)], "i int, chunk binary, secret_size int")
    coded = codec.encode(rows, coding).cache()
    for s, shares in coded.select("secret_size", "shares").collect():
        assert {len(x) for x in shares} == {spark.range(1).select(B.share_size(F.lit(s).cast("long"), coding)).first()[0]}
    for kept in list(itertools.combinations(range(coding.n), coding.k))[:6]:
        got = codec.decode(codec.keep_shares(coded, list(kept)), coding).orderBy("i").collect()
        assert [bytes(r["secret"]) for r in got] == secrets and all(r["intact"] for r in got)


def test_aes_vector(spark):
    # NIST SP 800-38A, CBC-AES256 key; one block under a zero vector is plain AES of the block
    key, block = "603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4", "6bc1bee22e409f96e93d7e117393172a"
    out = spark.range(1).select(F.hex(B.cipher(F.unhex(F.lit(block)), F.unhex(F.lit(key))))).first()[0]
    assert out.lower() == "f3eed1bdb5d2a03c064b5a7e3db181f8"


def test_field_and_matrices():
    for a in (1, 2, 77, 255):
        assert gf256.product(a, gf256.inverse(a)) == 1
    assert gf256.systematic(4, 1)[3].tolist() == [1, 142, 244]
    assert gf256.dispersal(4, 1)[0].tolist() == [71, 167, 122]
    m = gf256.cauchy(5, 5, 5)
    assert (gf256.matmul(m, gf256.invert(m)) == np.eye(5)).all()
    assert gf256.invert(np.zeros((2, 2), np.uint8)) is None


def test_parameters_are_checked():
    for bad in (dict(n=3, m=3), dict(n=2, m=1), dict(codec="no"), dict(codec="crsss", r=3)):
        with pytest.raises(ValueError):
            Coding(**bad)
    with pytest.raises(ValueError):
        Chunking(minimum=10)


def test_dedup_by_hand(spark):
    rows = [(0, 1, 0, "a", 10), (0, 1, 1, "a", 10), (1, 1, 0, "a", 10), (2, 2, 0, "a", 10), (2, 2, 1, "b", 10), (3, None, 0, "b", 10)]
    s = spark.createDataFrame(rows, "seq long, user_id int, secret_id int, fp string, share_size int")
    dup = {(r["seq"], r["secret_id"]): r["dup"] for r in dedup.intra_user(s).collect()}
    assert dup == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (2, 0): 0, (2, 1): 0, (3, 0): 0}
    assert {(r["fp"], r["seq"]) for r in dedup.inter_user(s).collect()} == {("a", 0), ("b", 2)}
    assert dedup.intra_user(s.limit(0)).count() == 0


def test_paths(spark):
    d = spark.createDataFrame([("/a/b/c",), ("a",), ("./x",), ("../x",), ("",), ("/",), (None,)], "p string")
    got = [r[0] for r in d.select(P.absolute(F.col("p"))).collect()]
    assert got == ["/a/b/c", "/a", None, None, None, "/", None]
    assert d.limit(1).select(P.ancestors(F.col("p"))).first()[0] == ["/", "/a/", "/a/b/"]
    assert spark.range(1).select(B.base26_name(F.lit(27), ".sc")).first()[0] == "aaaaaaaaaabb.sc"


def test_stream_equals_one_upload(spark, tmp_path):
    from stratavault.plans.upload import share_rows
    from stratavault.sources.files import documents_as_files
    from stratavault.streaming.incremental import start_dedup

    shares = share_rows(documents_as_files(spark, SF).drop("path"))
    src = str(tmp_path / "in")
    top = shares.agg(F.max("seq")).first()[0]
    for k in range(3):
        shares.where((F.col("seq") >= top * k // 3 + (k > 0)) & (F.col("seq") < top * (k + 1) // 3 + 1)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(shares.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = start_dedup(stream, str(tmp_path / "index"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "index"))
    assert got.count() == got.select("fp").distinct().count() == dedup.inter_user(shares).count()


def test_hashes_match_python(spark):
    r = catalogue.queries()["file_fingerprint"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").first()
    assert r["sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_files_out_and_in(spark, tmp_path):
    from stratavault.sources.files import read_clouds, read_files, write_files

    rows = [("a", 0, b"one "), ("a", 1, b"two"), ("b", 0, b"\0" * 70000)]
    chunks = spark.createDataFrame([(n, i, bytearray(x)) for n, i, x in rows], "name string, secret_id int, chunk binary")
    out = write_files(chunks.repartition("name").sortWithinPartitions("name", "secret_id"), str(tmp_path / "out")).collect()
    assert {(r["path"].rpartition("/")[2], r["file_size"], r["sha256"]) for r in out} == {("a", 7, hashlib.sha256(b"one two").hexdigest()), ("b", 70000, hashlib.sha256(b"\0" * 70000).hexdigest())}
    back = {r["path"].rpartition("/")[2]: (bytes(r["data"]), r["file_size"], r["user_id"]) for r in read_files(spark, str(tmp_path / "out"), 7).collect()}
    assert back == {"a": (b"one two", 7, 7), "b": (b"\0" * 70000, 70000, 7)}
    (tmp_path / "config").write_text("10.0.0.1:11030\n10.0.0.2:11031\n")
    assert [tuple(r) for r in read_clouds(spark, str(tmp_path / "config")).orderBy("cloud").collect()] == [(0, "10.0.0.1", 11030), (1, "10.0.0.2", 11031)]


def test_bad_shares_never_fail_the_others(spark):
    good = codec.encode(spark.createDataFrame([(0, bytearray(b"abc" * 50), 150)], "i int, chunk binary, secret_size int")).collect()[0]
    s = [bytes(x) for x in good["shares"]]
    cases = [
        ([0, 1, 2], s[:3], 150, b"abc" * 50), ([3, 1, 0], [s[3], s[1], s[0]], 150, b"abc" * 50), ([0, 1, 2], [s[0], s[1], s[2][:32]], 150, None), ([0, 0, 1], [s[0], s[0], s[1]], 150, None),
        ([0, 1, 4], s[:3], 150, None), ([0, 1], s[:2], 150, None), ([0, 1, 2], s[:3], 100_000, None), ([0, 1, 2], s[:3], -1, None), ([0, 1, 2], [s[0], None, s[2]], 150, None), ([0, 1, 2], [x[:31] for x in s[:3]], 10, None),
        ([0, 1, 2], None, 150, None), ([0, None, 2], s[:3], 150, None), ([0, 1, 2], s[:3], None, None), ([0, 1, 2], [b""] * 3, 0, None), ([1, 0, 2], s[:3], 150, None),
    ]
    rows = spark.createDataFrame([(k, i, None if p is None else [None if x is None else bytearray(x) for x in p], n) for k, (i, p, n, _) in enumerate(cases)], "k int, share_ids array<int>, kept array<binary>, secret_size int")
    for coding in (Coding(), Coding(codec="caont_rs_old")):
        got = {r["k"]: r["secret"] for r in codec.decode(rows, coding).collect()}
        if coding.codec == "caont_rs":
            assert [got[k] and bytes(got[k]) for k in range(len(cases))] == [w for *_, w in cases]
    assert codec.decode(rows, Coding(codec="crsss")).where("secret is not null").count() == 0


def test_vault(spark, tmp_path):
    from stratavault.operators import shares as S
    from stratavault.plans.vault import Vault

    rng = np.random.default_rng(4)
    block = rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()
    files = [(0, 1, "/a/x", block), (1, 1, "y", block[:3000] + b"new"), (2, 2, "/a/x", block), (3, 2, "../bad", b"gone"), (4, 2, "empty", b"")]
    make = lambda rows: spark.createDataFrame([(s, u, p, bytearray(d)) for s, u, p, d in rows], "seq long, user_id int, path string, data binary")
    vault = Vault(spark, str(tmp_path / "v"), variable=Chunking(64, 128, 256), container_bytes=2000)
    vault.upload(make(files), 0)
    second = [(5, 1, "/a/x", block[::-1]), (6, 2, "z", block)]
    vault.upload(make(second), 1)
    vault.upload(make(second), 1)  # a batch that is uploaded again replaces itself

    def restored(user: int, path: str, back: int = 0, clouds=None):
        asked = spark.createDataFrame([(user, path)], "user_id int, path string")
        rows = vault.restore(vault.request(asked, back), clouds).collect()
        return b"".join(bytes(r["chunk"]) for r in sorted(rows, key=lambda r: r["secret_id"]))

    assert restored(1, "a/x") == block[::-1] and restored(1, "a/x", 1) == block and restored(2, "/z") == block
    for lost in range(4):
        assert restored(1, "y", clouds=[c for c in range(4) if c != lost]) == block[:3000] + b"new"
    assert restored(1, "y", clouds=[0, 1]) == b"" and restored(3, "a/x") == b"" and restored(2, "../bad") == b"" and restored(2, "empty") == b""
    index = vault.index()
    assert index.count() == index.select("cloud", "share_fp").distinct().count()
    held = vault.committed("containers")
    assert held.where("octet_length(data) > 2000").count() == 0 and held.groupBy("batch", "cloud", "user_id").count().count() > 4
    assert {tuple(r)[1:] for r in vault.verify().collect()} == {(index.count() // 4, 0)}
    stats = {r["cloud"]: r for r in vault.stats().collect()}
    assert len(stats) == 4 and all(r["stored_bytes"] < r["logical_bytes"] for r in stats.values())
    assert vault.refs().agg(F.sum("ref_cnt")).first()[0] == vault.committed("recipes").count()
    # one flipped byte in each container of one cloud: found by verification, survived by restore
    rows = held.withColumn("data", F.when(F.col("cloud") == 2, F.concat(F.unhex(F.when(F.hex(F.substring("data", 1, 1)) == "00", "01").otherwise("00")), F.substring("data", F.lit(2), F.lit(1 << 20)))).otherwise(F.col("data")))
    bad = rows.where("cloud = 2").count()
    rows.write.partitionBy("batch").parquet(str(tmp_path / "tampered"))
    (tmp_path / "v" / "containers").rename(tmp_path / "was")
    (tmp_path / "tampered").rename(tmp_path / "v" / "containers")
    assert {r["cloud"]: r["n_bad"] for r in vault.verify().collect()} == {0: 0, 1: 0, 2: bad, 3: 0}
    assert restored(2, "z") == block and restored(1, "a/x") == block[::-1]
    # a batch whose files table is missing never happened
    (tmp_path / "v" / "files" / "batch=1").rename(tmp_path / "lost")
    assert restored(1, "a/x") == block and restored(2, "z") == b""
    with pytest.raises(ValueError):
        Vault(spark, str(tmp_path / "w"), Coding(codec="aont_rs"))
    assert S.verified(spark.createDataFrame([(None, "x")], "share binary, share_fp string")).first()["ok"] is False


def test_sorted_table_as_a_model(spark, tmp_path):
    from stratavault.operators import keyvalue
    from stratavault.sources.tables import SortedTable, exists

    rng = np.random.default_rng(6)
    table, model, log, seq = SortedTable(spark, str(tmp_path / "t"), files=2), {}, [], 0
    assert table.log() is None
    snapshots = []
    for step in range(6):
        rows = []
        for _ in range(40):
            key, seq = int(rng.integers(0, 50)), seq + 1
            if rng.random() < 0.45:
                rows.append((key, seq, "del", None))
                model.pop(key, None)
            else:
                rows.append((key, seq, "put", float(rng.integers(0, 99))))
                model[key] = rows[-1][3]
        log += rows
        table.write(spark.createDataFrame(rows, "key long, seq long, op string, value double"))
        snapshots.append(dict(model))
        if step == 3:
            table.compact(10, 30)
    state = lambda version=None: {r["key"]: r["value"] for r in keyvalue.latest(table.log(version)).collect()}
    assert state() == model and state(1) == snapshots[1]
    assert [(r["key"], r["value"]) for r in table.get([3, 7, 12]).orderBy("key").collect()] == [(k, model[k]) for k in (3, 7, 12) if k in model]
    assert [r["key"] for r in keyvalue.scan(table.log(), 10, 40).collect()] == sorted(k for k in model if 10 <= k < 40)
    assert [r["key"] for r in keyvalue.seek(table.log(), 20, 3, reverse=True).collect()] == sorted((k for k in model if k <= 20), reverse=True)[:3]
    assert [r["key"] for r in keyvalue.scan(table.log(), comparator=lambda key: key % 7 * 100 + key).collect()] == sorted(model, key=lambda k: (k % 7, k))
    # half a segment, then lost manifests
    (tmp_path / "t" / "segment-half").mkdir()
    for f in (tmp_path / "t" / "manifest").iterdir():
        f.unlink()
    table.repair()
    assert state() == model and table.stats().agg(F.sum("n_changes")).first()[0] >= len(model)
    table.compact()
    table.vacuum()
    assert state() == model and table.log().where("op = 'del'").count() == 0 and table.dump().select("file").distinct().count() <= 2
    table.destroy()
    assert not exists(spark, str(tmp_path / "t"))


def test_tiers(spark, tmp_path):
    from stratavault.sources.tables import Tiers, exists, make_folder, readable, size_of

    cache, backend = str(tmp_path / "cache"), str(tmp_path / "backend")
    make_folder(spark, cache)
    tiers = Tiers(spark, cache, backend, 25)
    for name in "abc":
        (tmp_path / "cache" / name).write_bytes(name.encode() * 10)
        tiers.add(name)
    assert list(tiers.used) == ["a", "b", "c"] and not exists(spark, f"{backend}/a")
    assert tiers.drain() == 3 and list(tiers.used) == ["b", "c"] and not exists(spark, f"{cache}/a") and size_of(spark, backend) == 30
    tiers.open("b")
    assert open(tiers.open("a"), "rb").read() == b"a" * 10 and list(tiers.used) == ["b", "a"]
    assert readable(spark, f"{backend}/c") and not readable(spark, f"{backend}/d")
    with pytest.raises(FileNotFoundError):
        tiers.open("d")


def test_encodings(spark):
    from stratavault.functions import encodings as E

    # CRC-32C vectors of RFC 3720
    rows = [(bytearray(32),), (bytearray(b"\xff" * 32),), (bytearray(range(32)),), (bytearray(b"123456789"),), (bytearray(b""),), (None,)]
    got = spark.createDataFrame(rows, "d binary").select(E.crc32c(F.col("d")).alias("c"), E.unmasked(E.masked(E.crc32c(F.col("d")))).alias("m"), E.masked(E.crc32c(F.col("d"))).alias("k")).collect()
    assert [r["c"] for r in got] == [0x8A9136AA, 0x62A8AB43, 0x46DD794E, 0xE3069283, 0, None]
    assert [r["m"] for r in got] == [r["c"] for r in got] and all(r["k"] != r["c"] for r in got[:5])
    assert E.crc32c_of(b"6789", E.crc32c_of(b"12345")) == 0xE3069283
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 1 << 31, (1 << 63) - 1]
    v = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", E.varint(F.col("n")).alias("v"), E.read_varint(E.varint(F.col("n"))).alias("back"), E.fixed(F.col("n"), 8).alias("f")).collect()

    def slow(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + slow(n >> 7)

    assert all(bytes(r["v"]) == slow(r["n"]) and r["back"] == r["n"] and int.from_bytes(r["f"], "little") == r["n"] for r in v)
    assert len({E.hash_of(b"x" * k, 7) for k in range(40)}) == 40 and E.hash_of(b"", 5) == 5
    assert abs(spark.range(1).select(E.epoch_seconds() - E.epoch_seconds(F.current_timestamp())).first()[0]) < 1


@pytest.mark.parametrize("width", [4, 8, 16, 32])
def test_field_widths(width):
    rng = np.random.default_rng(width)
    top = (1 << width) - 1
    for _ in range(20):
        a, b, c = (int(x) for x in rng.integers(1, top, 3, endpoint=True))
        assert gf256.product(a, gf256.inverse_in(a, width), width) == 1
        assert gf256.product(a, b ^ c, width) == gf256.product(a, b, width) ^ gf256.product(a, c, width)
    data = rng.integers(0, 256, 24, dtype=np.uint8).tobytes()
    out = gf256.region_in(a, data, width)
    assert all(gf256.extract_word(out, width, i) == gf256.product(a, gf256.extract_word(data, width, i), width) for i in range(24 * 8 // width))


def test_cauchy_variants():
    plain, better = gf256.cauchy(3, 4, 3), gf256.good(3, 4)
    ones = lambda m: sum(gf256.bit_ones(int(a)) for a in m.ravel())
    assert ones(better) < ones(plain) and (better[0] == 1).all()
    for m in (plain, better, gf256.improved(plain), gf256.good(2, 6), gf256.cauchy_of([1, 2, 9], [3, 4, 5, 6])):
        code = np.vstack([np.eye(m.shape[1], dtype=np.uint8), m])
        assert all(gf256.invert(code[list(rows)]) is not None for rows in itertools.combinations(range(len(code)), m.shape[1]))
    with pytest.raises(ValueError):
        gf256.cauchy_of([1, 2], [2, 3])


def test_caches_as_the_plain_rule(spark):
    from stratavault.operators import caching

    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 12)), f"g{i % 2}") for i in range(400)]
    reads = spark.createDataFrame([(i, x, g, x + 1) for i, x, g in rows], "i long, item long, g string, size long")
    got = {r["i"]: (r["hit"], r["evicted"]) for r in caching.lru(reads, "item", "i", 30, ["g"], "size").collect()}
    held = {"g0": [], "g1": []}
    for i, x, g in rows:
        c, hit, gone = held[g], x in held[g], 0
        c[:] = [y for y in c if y != x] + [x]
        while sum(y + 1 for y in c) > 30 and len(c) > 1:
            c.pop(0)
            gone += 1
        assert got[i] == (hit, gone)
    assert caching.lru(reads.limit(0), "item", "i", 3, ["g"]).count() == 0


def test_a_file_may_span_batches(spark, tmp_path):
    from stratavault.plans.upload import share_rows
    from stratavault.sources.files import documents_as_files

    # the chunks of one file arrive in parts: past and coming counts go on, and the file is complete in the end
    s = share_rows(documents_as_files(spark, SF).drop("path"))
    batched = dedup.batch_counts(dedup.upload_batches(s, ["doc_id"], 1024), ["doc_id"])
    ends = batched.groupBy("doc_id").agg(F.max(F.col("past_bytes") + F.col("coming_bytes")).alias("n"))
    want = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.octet_length("text").alias("size"))
    assert ends.join(want, "doc_id").where("n <> size").count() == 0


def test_streamed_upload_equals_one_upload(spark, tmp_path):
    from stratavault.plans.vault import Vault
    from stratavault.streaming.incremental import start_upload

    rng = np.random.default_rng(8)
    blocks = [rng.integers(0, 256, 700, dtype=np.uint8).tobytes() for _ in range(4)]
    files = [(i, i % 2, f"f{i}", blocks[i % 4] + blocks[i % 3]) for i in range(9)]
    make = lambda rows: spark.createDataFrame([(s, u, p, bytearray(d)) for s, u, p, d in rows], "seq long, user_id int, path string, data binary")
    src = str(tmp_path / "in")
    for k in range(3):
        make(files[3 * k : 3 * k + 3]).coalesce(1).write.mode("append").parquet(src)
    streamed, whole = Vault(spark, str(tmp_path / "s"), size=128), Vault(spark, str(tmp_path / "w"), size=128)
    stream = spark.readStream.schema("seq long, user_id int, path string, data binary").option("maxFilesPerTrigger", 1).parquet(src)
    start_upload(stream, streamed, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
    whole.upload(make(files), 0)
    shares = lambda v: {(r["cloud"], r["share_fp"]) for r in v.index().collect()}
    assert shares(streamed) == shares(whole) and streamed.table("files").select("batch").distinct().count() == 3
    asked = make(files).select("user_id", "path")
    got = {}
    for r in streamed.restore(streamed.request(asked), [0, 2, 3]).orderBy("inode_fp", "secret_id").collect():
        got[r["inode_fp"]] = got.get(r["inode_fp"], b"") + bytes(r["chunk"])
    assert sorted(got.values()) == sorted(d for *_, d in files)


def test_scratch_folder():
    from types import SimpleNamespace

    from stratavault.scratch import shared_root

    def session(master: str, folder: str | None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)

    assert shared_root(session("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert shared_root(session("local[4]", None))
    with pytest.raises(ValueError):  # executors of a cluster would not see a folder of this machine
        shared_root(session("local-cluster[2,1,1024]", None))


def test_entry_without_the_training_data_subpackage(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def broken(name, *a, **k):
        if name == "stratavault.llm":
            raise ImportError("xxhash is missing")
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m.startswith("stratavault.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", broken)
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: type("Spec", (), {"origin": "here"})())
    with pytest.warns(UserWarning, match="xxhash"):
        assert set(entry.queries()) == set(catalogue.queries())


def test_in_memory_table(spark):
    from stratavault.sources.tables import in_memory

    held = in_memory(spark.range(5), "five")
    assert spark.sql("select sum(id) as s from five").first()["s"] == 10 and held.is_cached
    held.unpersist()


def _uploaded(spark, at, files, batches=1, **options):
    from stratavault.plans.vault import Vault

    vault = Vault(spark, str(at), **({"size": 256} | options))
    make = lambda rows: spark.createDataFrame([(s, u, p, bytearray(d)) for s, u, p, d in rows], "seq long, user_id int, path string, data binary")
    for k in range(batches):
        vault.upload(make(files[k::batches]), k)
    return vault, make


def test_vault_keeps_each_share_and_its_fingerprint_once(spark, tmp_path):
    from stratavault.sources.tables import size_of

    rng = np.random.default_rng(5)
    files = [(i, i % 3, f"f{i}", rng.integers(0, 256, 40_000, dtype=np.uint8).tobytes()) for i in range(12)]
    vault, _ = _uploaded(spark, tmp_path / "v", files)
    # four shares are 1.5 times a secret of 256 bytes and their fingerprints half of it; lists and places come on top
    assert size_of(spark, vault.root) < 2.6 * sum(len(d) for *_, d in files)


def test_containers_are_zipped_where_they_are_read(spark, tmp_path):
    from stratavault.operators import shares as S

    rng = np.random.default_rng(6)
    block = rng.integers(0, 256, 9000, dtype=np.uint8).tobytes()
    # a row that comes twice, a file whose number another user's has too, one of zeros, and one that ends in them
    files = [(0, 1, "a", block), (0, 1, "a", block), (0, 2, "a", block[:300] + block[600:]), (3, 2, "z", bytes(700)), (4, -1, "n", block[::-1] + bytes(5))]
    vault, make = _uploaded(spark, tmp_path / "v", files, container_bytes=1000)
    held = vault.committed("containers").where("cloud > 0")
    zipped = S.zip_containers(held, vault.coding)
    assert "Exchange" not in zipped._jdf.queryExecution().toString()
    want = {bytes(r["fp"]) for r in zipped.collect()}
    assert zipped.count() == len(want) == vault.committed("secrets").count()
    assert {bytes(r["fp"]) for r in S.zip_containers(held.repartition(7, F.rand(1)), vault.coding).collect()} == want  # in any order
    assert S.zip_containers(held.where("cloud > 1"), vault.coding).count() == 0
    found = vault.committed("files").select("inode_fp", "version").distinct()
    got = {}
    for r in vault.restore(found, [1, 2, 3]).orderBy("inode_fp", "secret_id").collect():
        got[r["inode_fp"]] = got.get(r["inode_fp"], b"") + bytes(r["chunk"])
    assert sorted(got.values()) == sorted({d for *_, d in files})


def test_restore_after_an_earlier_batch_is_uploaded_again(spark, tmp_path):
    rng = np.random.default_rng(7)
    blocks = [rng.integers(0, 256, 1000, dtype=np.uint8).tobytes() for _ in range(3)]
    vault, make = _uploaded(spark, tmp_path / "v", [(0, 1, "a", blocks[0]), (1, 1, "b", blocks[1])], 2)
    again = [(0, 1, "a", blocks[0]), (2, 1, "c", blocks[1] + blocks[2])]
    vault.upload(make(again), 0)
    assert vault.committed("secrets").groupBy("fp").count().where("count > 1").count() == 0
    rows = vault.restore(vault.request(make(again).select("user_id", "path"))).orderBy("inode_fp", "secret_id").collect()
    assert sorted(len(b"".join(bytes(r["chunk"]) for r in rows if r["inode_fp"] == f)) for f in {r["inode_fp"] for r in rows}) == [1000, 2000]


def test_container_names_beyond_two_letters_follow_the_sql(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(9)
    # one user with 116,000 different chunks of 256 bytes, of whose shares 170 fill a container
    texts = [rng.integers(0, 256, 128_000, dtype=np.uint8).tobytes().hex() for _ in range(116)]
    pq.write_table(pa.table({"doc_id": pa.array(range(116), pa.int64()), "text": texts, "lang": ["en"] * 116, "source": ["src4"] * 116}), tmp_path / "documents.parquet")
    got = catalogue.queries()["container_packing"](spark, str(tmp_path)).select("container_no", "container").distinct().collect()
    name = re.search(r"('aaaaaaaaaa'.*) as container from r$", catalogue.oracle_sql()["container_packing"], re.S)[1]
    want = duckdb.sql(f"select batch, {name} from (select unnest(range(683)) as batch)").fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) == len(got)


def test_all_clouds_of_a_container_lie_in_one_file(spark, tmp_path):
    rng = np.random.default_rng(10)
    files = [(i, i % 5, f"f{i}", rng.integers(0, 256, 6000, dtype=np.uint8).tobytes()) for i in range(10)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one file's anyway
    try:
        vault, _ = _uploaded(spark, tmp_path / "v", files, container_bytes=1000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = vault.committed("containers").select("user_id", "container_no", "cloud", F.input_file_name().alias("file"), F.octet_length("data").alias("size"))
    each = held.groupBy("user_id", "container_no").agg(F.countDistinct("file"), F.countDistinct("cloud"), F.countDistinct("size"))
    assert {tuple(r)[2:] for r in each.collect()} == {(1, 4, 1)}


def test_restore_in_turns_moves_a_part_at_a_time(spark, tmp_path):
    from stratavault.operators import catalog

    rng = np.random.default_rng(11)
    block = lambda n: rng.integers(0, 256, n, dtype=np.uint8).tobytes()
    common = [block(2560) for _ in range(3)]
    # files share blocks with files far from them, one is a copy, one of zeros, one comes twice, and one user has most
    files = [(i, 0 if i % 3 else 1, f"f{i}", common[i % 3] + block(20_000 + 13 * i)) for i in range(30)]
    files += [(30, 1, "copy", files[2][3]), (31, 1, "zeros", bytes(5000)), (32, 0, "twice", files[5][3]), (32, 0, "twice", files[5][3])]
    vault, make = _uploaded(spark, tmp_path / "v", files, 2, container_bytes=3000)
    found = vault.committed("files").select("inode_fp", "version").distinct()
    known = {x.stageId() for x in _stages(spark)}
    got = vault.restore_into(lambda chunks: catalog.digests(chunks, "inode_fp"), found, [1, 2, 3], turn_bytes=200_000)
    assert sorted(r["sha256"] for r in got.collect()) == sorted([hashlib.sha256(d).hexdigest() for *_, d in files[:-1]])
    most = max(x.shuffleWriteBytes() for x in _stages(spark) if x.stageId() not in known)
    assert most < 0.6 * sum(len(d) for *_, d in files)  # restore moves all of them at once


def _stages(spark):
    """Stages that Spark still knows, newest first."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm
    rows = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [rows.apply(i) for i in range(rows.size())]
