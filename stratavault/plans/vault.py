"""The store itself: upload, restore, verification and repair over tables under one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import binary as B
from ..operators import catalog, chunking, dedup, shares as S
from ..params import BUFFER_BYTES, Chunking, Coding
from ..scratch import folder, settle
from ..sources.tables import delete, exists, finished


#: Turns in which an upload writes its users' containers, and bytes that a file of these holds at most, so that it is one row group.
TURNS, FILE_BYTES = 6, 32 << 20
#: Turns in which ``restore_into`` restores files at most, bytes of secrets below which one more isn't worth its jobs, and secrets named to all executors at once.
RESTORE_TURNS, TURN_BYTES, SLOTS = 24, 4 << 20, 500_000


class Vault:
    """Tables under ``root`` (any folder that all executors see), each written a batch at a time:

    containers (cloud, user_id, container_no, first_seq, last_seq, entries, data), secrets (fp, user_id, container_no,
    offset, ...: the place is the same in each cloud), lists (inode_fp, user_id, seq, secret_id,
    secret_size, fp, version), inodes (inode_fp, user_id, full_path, ...), files (inode_fp,
    version, seq, file_size).  A batch is a folder ``batch=N``, replaced as a whole if it is
    uploaded again, and counts once its line in ``files``, which is written last, is
    there.  ``recipes`` are read from lists, secrets and containers' entries.
    """

    def __init__(self, spark: SparkSession, root: str, coding: Coding | None = None, size: int | None = None, variable: Chunking | None = None, container_bytes: int = BUFFER_BYTES):
        if (coding or Coding()).codec == "aont_rs":
            raise ValueError("aont_rs draws a new key each time, so its shares can't be deduplicated")
        self.spark, self.root, self.coding = spark, root, coding or Coding()
        self.size, self.variable, self.container_bytes = size, variable or (None if size else Chunking()), container_bytes

    def table(self, name: str) -> DataFrame | None:
        path = f"{self.root}/{name}"
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def batches(self) -> list[int]:
        """The finished batches."""
        return [int(n.removeprefix("batch=")) for n in finished(self.spark, f"{self.root}/files")]

    def committed(self, name: str) -> DataFrame | None:
        """The table's rows of finished batches; other folders aren't read."""
        if name == "recipes":
            return self.recipes()
        done = self.batches()
        rows = self.table(name) if done else None
        return None if rows is None else rows.where(F.col("batch").isin(done))

    def _put(self, rows: DataFrame, name: str, batch: int, mode: str = "overwrite", at_most: int = 0) -> DataFrame:
        """``at_most``: rows of a file, if not 0."""
        path = f"{self.root}/{name}/batch={batch}"
        rows.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", at_most).parquet(path)
        return self.spark.read.parquet(path)

    def cut(self, files: DataFrame) -> DataFrame:
        return chunking.variable_chunks(files, self.variable) if self.variable else chunking.fixed_chunks(files, self.size)

    def upload(self, files: DataFrame, batch: int) -> None:
        """Files (seq, user_id, path, data) become the versions ``batch`` of their inodes.

        Dedup goes by the fingerprint of the zero-padded secret, which decides all its
        shares: only secrets that no other batch has are encoded, each once, and only
        they go to containers, with the user of their first arrival (by seq, then
        secret_id).  Invalid paths go.
        """
        self._drop(f"files/batch={batch}")
        named = catalog.inodes(files)
        chunks = self.cut(named.select("seq", "user_id", "inode_fp", "data"))
        whole = B.pad_zero(F.col("chunk"), B.aligned_size(F.col("secret_size"), self.coding))
        chunks = chunks.withColumn("fp", B.fingerprint(whole))
        meta = self._put(chunks.select("inode_fp", "user_id", "seq", "secret_id", "secret_size", "fp", F.lit(batch).alias("version")), "lists", batch)
        known = self.committed("secrets")
        first = meta.groupBy("fp").agg(F.min(F.struct("seq", "secret_id", "user_id", "secret_size")).alias("x")).select("fp", "x.*")
        fresh = first if known is None else first.join(known.where(F.col("batch") != batch), "fp", "left_anti")
        sized = fresh.withColumn("share_size", B.share_size(F.col("secret_size"), self.coding))
        placed = dedup.upload_batches(sized, ["user_id"], self.container_bytes, order=["seq", "secret_id"]).withColumnRenamed("batch", "container_no")
        new = self._put(placed, "secrets", batch)
        places = new.select(F.unhex("fp").alias("fp"), "seq", "secret_id", "user_id", "container_no", "offset")
        # a container is its user's, so users can be taken in turns, of which each frees what it has moved
        of_turn = lambda turn: F.pmod(F.hash("user_id"), F.lit(TURNS)) == turn
        per_file = self.coding.n * max(1, FILE_BYTES // (self.coding.n * self.container_bytes))
        # the largest first, so that little is moved when most containers are there
        weights = {r["turn"]: r["n"] for r in new.groupBy(F.pmod(F.hash("user_id"), F.lit(TURNS)).alias("turn")).agg(F.sum("share_size").alias("n")).collect()}
        for i, turn in enumerate(sorted(range(TURNS), key=lambda x: -weights.get(x, 0))):
            if i and turn not in weights:
                continue
            settle(self.spark)
            chunks = self.cut(named.where(of_turn(turn)).select("seq", "data")).withColumn("fp", F.unhex(B.fingerprint(whole)))
            held = chunks.join(places.where(of_turn(turn)), ["fp", "seq", "secret_id"])
            self._put(S.pack_containers(held, self.coding), "containers", batch, "append" if i else "overwrite", per_file)
        self._put(named.select("inode_fp", "dir_fp", "user_id", "full_path", "dir", "name").distinct(), "inodes", batch)
        self._put(named.select("inode_fp", "seq", F.octet_length("data").cast("long").alias("file_size"), F.lit(batch).alias("version")), "files", batch)
        settle(self.spark)

    def _drop(self, name: str) -> None:
        delete(self.spark, f"{self.root}/{name}")

    def index(self) -> DataFrame | None:
        """Where each share lies; read from the containers' entries, of which no bytes are touched."""
        held = self.committed("containers")
        return None if held is None else S.index_of(held)

    repair = index  # the entries lie with the bytes, so an index that is lost is read again from the containers

    def recipes(self) -> DataFrame | None:
        """(inode_fp, user_id, version, secret_id, secret_size, cloud, share_fp, share_size, batch): every file's shares in each cloud, a row each."""
        lists, secrets = self.committed("lists"), self.committed("secrets")
        if lists is None:
            return None
        at = ["batch", "user_id", "container_no", "offset"]
        index, places = self.index(), secrets.select("fp", *[F.col(c).alias(f"__{c}") for c in at])
        shares = places.join(index, [index[c].eqNullSafe(places[f"__{c}"]) for c in at]).select("fp", "cloud", "share_fp", "share_size")
        return lists.join(shares, "fp").drop("fp", "seq")

    def refs(self) -> DataFrame:
        """(cloud, share_fp, user_id, ref_cnt) over all recipes; counts only grow."""
        return self.committed("recipes").groupBy("cloud", "share_fp", "user_id").agg(F.count("*").alias("ref_cnt"))

    def stats(self) -> DataFrame:
        """Per cloud: share bytes that recipes name, and bytes in containers."""
        logical = self.committed("recipes").groupBy("cloud").agg(F.count("*").alias("n_shares"), F.sum("share_size").alias("logical_bytes"))
        stored = self.index().groupBy("cloud").agg(F.count("*").alias("n_stored"), F.sum("share_size").alias("stored_bytes"))
        return logical.join(stored, "cloud", "left")

    def request(self, requests: DataFrame, back: int = 0) -> DataFrame:
        """(inode_fp, version, requests' columns) of the files that (user_id, path) requests ask for, ``back`` versions before the newest."""
        files = catalog.at_version(self.committed("files").select("inode_fp", "version").distinct(), ["inode_fp"], "version", back)
        return catalog.find_files(requests, files).where("found")

    def shares_of(self, wanted: DataFrame, clouds: list[int] | None = None) -> DataFrame:
        """(inode_fp, version, secret_id, secret_size, cloud, share_fp, share) of files (inode_fp, version): recipe, index, container slice."""
        recipe = self.committed("recipes").drop("user_id", "batch")
        if clouds is not None:
            recipe = recipe.where(F.col("cloud").isin(clouds))
        recipe = recipe.join(wanted.select("inode_fp", "version").distinct(), ["inode_fp", "version"])
        needed = self.index().join(recipe.select("cloud", "share_fp").distinct(), ["cloud", "share_fp"], "left_semi")
        got = S.fetch(needed, self.committed("containers"))
        return recipe.join(got, ["cloud", "share_fp"], "left")

    def restore(self, wanted: DataFrame, clouds: list[int] | None = None) -> DataFrame:
        """(inode_fp, secret_id, chunk) of files (inode_fp, version), in order within a partition, from any k clouds.

        Shares whose bytes no longer have their fingerprint count as lost, as do those
        of clouds that aren't asked.  Containers are zipped and decoded where they are read,
        and a secret serves if its own fingerprint is the list's; a file of which a secret can't be rebuilt is left out.
        """
        secrets = S.zip_containers(self._held(clouds), self.coding)
        lists = self.committed("lists").join(wanted.select("inode_fp", "version").distinct(), ["inode_fp", "version"], "left_semi")
        return self._files(self._asked(lists), secrets, ["fp"])

    def _held(self, clouds: list[int] | None) -> DataFrame:
        held = self.committed("containers")
        return held if clouds is None else held.where(F.col("cloud").isin(clouds))

    def _asked(self, lists: DataFrame) -> DataFrame:
        asked = lists.select(F.unhex("inode_fp").alias("inode"), "secret_id", "secret_size", F.unhex("fp").alias("fp"))
        return asked.repartition("fp").distinct()  # dealt as the join wants it

    def _files(self, asked: DataFrame, secrets: DataFrame, by: list[str]) -> DataFrame:
        found = asked.join(secrets, by, "left").select("inode", "secret_id", F.substring(F.col("secret"), F.lit(1), F.col("secret_size")).alias("chunk"))
        ordered = found.repartition("inode").sortWithinPartitions("inode", "secret_id")
        every = W.partitionBy("inode").orderBy("secret_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        whole = ordered.withColumn("__broken", F.max(F.col("chunk").isNull()).over(every)).where(~F.col("__broken"))
        return whole.select(F.lower(F.hex("inode")).alias("inode_fp"), "secret_id", "chunk")

    def restore_into(self, sink: Callable[[DataFrame], DataFrame], wanted: DataFrame, clouds: list[int] | None = None, turn_bytes: int = TURN_BYTES) -> DataFrame:
        """What ``sink`` (``digests``, ``write_files``) makes of ``restore``'s rows, in turns of which each frees the bytes it has moved.

        A turn is a range of seq: the files of it, from the containers that hold
        secrets of it.  Secrets that a file shares with a file of another turn are
        fetched for all turns beforehand, so a secret is decoded once or twice, however
        many turns there are.  If a batch has a file more than once, its last row serves.
        """
        lists, secrets, held = self.committed("lists"), self.committed("secrets"), self._held(clouds)
        n_bytes = lists.agg(F.sum("secret_size")).first()[0] or 0
        turns = max(1, min(RESTORE_TURNS, n_bytes // turn_bytes))
        if turns == 1:
            return sink(self.restore(wanted, clouds))
        cuts = sorted(set(lists.agg(F.percentile_approx("seq", [i / turns for i in range(1, turns)], 10_000)).first()[0]))
        ends = [None, *cuts, None]  # a turn's seqs lie above one end and not above the next
        turn_of = sum(((F.col("seq") > c).cast("int") for c in cuts), F.lit(0))

        def within(first: int, last: int, low: str = "seq", high: str = "seq"):
            """Whether low to high meets the turns from first to last."""
            above = F.lit(True) if ends[first] is None else F.col(high) > ends[first]
            return above if ends[last + 1] is None else above & (F.col(low) <= ends[last + 1])

        at = folder(self.spark, "restored")

        def keep(rows: DataFrame, name: str, by: list[str] | None = None) -> None:
            rows.write.mode("append").option("compression", "zstd").partitionBy(*by or []).parquet(f"{at}/{name}")
            settle(self.spark)

        read = lambda name: self.spark.read.parquet(f"{at}/{name}")
        files = self.committed("files").join(wanted.select("inode_fp", "version").distinct(), ["inode_fp", "version"], "left_semi")
        keep(files.groupBy("inode_fp", "version").agg(F.max("seq").alias("seq")), "wanted")
        mine = lists.join(read("wanted"), ["inode_fp", "version", "seq"], "left_semi")
        places = ["batch", "user_id", "container_no"]
        parts = min(8, len(ends) - 1)
        for part in range(parts):
            of_part = F.pmod(F.hash("fp"), F.lit(parts)) == part
            asked = mine.where(of_part).select(F.unhex("fp").alias("fp"), turn_of.alias("turn")).distinct()
            homes = secrets.where(of_part).select(F.unhex("fp").alias("fp"), *places, "offset", turn_of.alias("home"))
            keep(asked.join(homes, "fp").where("turn <> home"), "away")
        away, last = read("away"), len(cuts)
        steps = max(1, min(last + 1, -(-away.count() // SLOTS)))
        for step in range(steps):
            low, high = (last + 1) * step // steps, (last + 1) * (step + 1) // steps - 1
            due = away.where(F.col("home").between(low, high))
            slots = due.groupBy(*places).agg(F.collect_set("offset").alias("slots"))
            some = held.where(within(low, high, "first_seq", "last_seq")).join(F.broadcast(slots), places)
            keep(S.zip_containers(some, self.coding).join(due.select("fp", "turn").distinct(), "fp"), "shared", ["turn"])
        for turn in range(last + 1):
            of_turn = F.col("turn") == turn
            far = away.where(of_turn).select("fp", F.lit(True).alias("away")).distinct()
            asked = self._asked(lists.where(within(turn, turn)).join(read("wanted").where(within(turn, turn)), ["inode_fp", "version", "seq"], "left_semi"))
            asked = asked.join(far, "fp", "left").withColumn("away", F.coalesce("away", F.lit(False)))
            near = S.zip_containers(held.where(within(turn, turn, "first_seq", "last_seq")), self.coding).withColumn("away", F.lit(False))
            shared = self.spark.read.schema("fp binary, secret binary, turn int").parquet(f"{at}/shared").where(of_turn)
            got = near.unionByName(shared.select("fp", "secret", F.lit(True).alias("away")))
            keep(sink(self._files(asked, got, ["fp", "away"])), "out")
        for name in ("wanted", "away", "shared"):
            delete(self.spark, f"{at}/{name}")
        return read("out")

    def verify(self) -> DataFrame:
        """(cloud, n_shares, n_bad) over all stored bytes."""
        kept = self.committed("containers")
        cut = F.transform("entries", lambda x: F.struct(F.lower(F.hex(x["share_fp"])).alias("share_fp"), F.substring(F.col("data"), (x["offset"] + 1).cast("int"), x["share_size"].cast("int")).alias("share")))
        rows = kept.select("cloud", F.explode(cut).alias("e")).select("cloud", "e.*")
        return S.verified(rows).groupBy("cloud").agg(F.count("*").alias("n_shares"), F.sum((~F.col("ok")).cast("long")).alias("n_bad"))
