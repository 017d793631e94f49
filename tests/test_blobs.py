"""Contents by digest: retried and rival batches, removal, reading back."""

from __future__ import annotations

import hashlib

from ledgerloom.sources import blobs
from ledgerloom.sources.snapshots import Snapshots

KEY = lambda b: hashlib.sha256(b).hexdigest()


def frame(spark, contents):
    return spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(contents)], "i int, body binary")


def held(store):
    return sorted((r.sha256, r.bytes) for r in blobs.listing(store).collect())


def test_a_batch_again_adds_nothing(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    assert held(s) == []
    rows = frame(spark, [b"one", b"two", b"one", b"", None, bytes(range(256)) * 4000])
    blobs.put(s, rows, "body")
    want = sorted((KEY(b), len(b)) for b in (b"one", b"two", b"", bytes(range(256)) * 4000))
    assert held(s) == want
    blobs.put(s, rows, "body")
    assert held(s) == want
    assert blobs.damaged(s).count() == 0


def test_rival_batches_leave_one_of_each(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))

    class Slow(Snapshots):
        """Another batch commits after this one has looked and before it commits."""

        waited = False

        def commit(self, base, append=None, replace=None):
            if not Slow.waited:
                Slow.waited = True
                blobs.put(s, frame(spark, [b"both", b"theirs"]), "body")
            return super().commit(base, append, replace)

    blobs.put(Slow(spark, str(tmp_path)), frame(spark, [b"both", b"mine"]), "body")
    assert Slow.waited and held(s) == sorted((KEY(b), len(b)) for b in (b"both", b"theirs", b"mine"))
    assert s.latest() == 2


def test_get_remove_and_put_again(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    first = blobs.put(s, frame(spark, [b"a", b"b"]), "body")
    keys = spark.createDataFrame([(KEY(b"a"), 7), (KEY(b"b"), 7), ("../../etc", 7), (None, 7)], "k string, bytes int")
    read = lambda version=None: {r.k: (r.bytes, None if r.content is None else bytes(r.content)) for r in blobs.get(s, keys, "k", version).collect()}
    whole = {KEY(b"a"): (1, b"a"), KEY(b"b"): (1, b"b"), "../../etc": (None, None), None: (None, None)}
    assert read() == whole
    blobs.remove(s, keys.where("k <> '" + KEY(b"b") + "'"), "k")
    assert read() == whole | {KEY(b"a"): (None, None)}
    assert read(first) == whole
    blobs.put(s, frame(spark, [b"a"]), "body")
    assert read() == whole and len(held(s)) == 2
