"""Centroid clustering, hard negatives and WARC archives: odd tables, brute-force versions, exact round trips."""

import base64
import hashlib
from collections import Counter
from math import floor, inf, nan

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from sievewright.llm import centroid_clusters, hard_negatives, queries, warc_archive

VECTORS = "vec_id long, label int, embedding array<double>, cluster string, distance string, v string, dots string, anchor string, slot string, score string, block string"


def odd_vectors(spark, side, rows):
    """rows (vec_id, label, vector), with further columns of names that the operators use inside."""
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], VECTORS)


def clustered(rows, k, rounds):
    """The plain version."""
    kept = [(i, [floor(64 * x) for x in v]) for i, _, v in rows if v is not None and len(v) == 64 and all(x is not None and abs(x) < inf for x in v)]
    centres = [v for _, v in sorted(((i, v) for i, v in kept if i is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in set(own):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            centres[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in out)


@pytest.mark.parametrize("n", [0, 5, 300])
def test_clusters_by_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), 0, [float(x) for x in rng.normal(size=64) * (1 + i % 3)]) for i in range(n)]
    rows += [(*r[:2], r[2]) for r in rows[:3]] + [(None, 0, r[2][::-1]) for r in rows[:2]]  # repeated rows, null ids
    rows += [(1000, 0, None), (1001, 0, [1.0] * 63), (1002, 0, [1.0] * 63 + [None]), (1003, 0, [nan] + [0.0] * 63), (1004, 0, [inf] + [0.0] * 63), (1005, 0, [])]
    rows += [(2000 + i, 0, [float(i % 2)] * 64) for i in range(6 * (n > 0))]  # ties
    df = odd_vectors(spark, 64, rows)
    got = centroid_clusters.cluster_vectors(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == clustered(rows, 16, 3)
    assert Counter(tuple(r) for r in centroid_clusters.cluster_vectors(df.repartition(5), 4, 6).collect()) == clustered(rows, 4, 6)


def test_components_out_of_range(spark):
    rows = [(i, 0, [sign * 1e300] * 64) for i, sign in enumerate((1, 1, -1))] + [(3, 0, [0.0] * 64)]
    got = {r.vec_id: r for r in centroid_clusters.cluster_vectors(odd_vectors(spark, 64, rows)).collect()}
    assert len(got) == 4 and all(r.distance == 0 and r.inertia == 0 for r in got.values())


def mined(rows, every, positives, negatives, low, high):
    """The plain version: every pair."""
    kept = {(i, lab, tuple(floor(256 * x) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and abs(x) < inf for x in v)}
    out = set()
    for a, lab, v in kept:
        if a % every == 0:
            scored = sorted({(-sum(x * y for x, y in zip(v, w, strict=True)), b, m == lab) for b, m, w in kept if len(w) == len(v)})
            for s, p in sorted({(s, b) for s, b, same in scored if same and b != a})[:positives]:
                inside = sorted({(t, b) for t, b, same in scored if not same and low * -s <= 100 * -t <= high * -s})
                out |= {(a, p, k + 1, b, -s, -t) for k, (t, b) in enumerate(inside[:negatives])}
    return out


@pytest.mark.parametrize("block", [8192, 7])
def test_negatives_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CELLS", 300)
    monkeypatch.setattr(hard_negatives, "HELD", 40)
    rng = np.random.default_rng(block)
    rows = [(int(i), int(rng.integers(4)) if i % 3 else 1, [float(x) for x in rng.integers(-3, 6, size=3 + (i % 10 == 9)) / 4]) for i in range(400)]  # many ties, a hot label, two lengths
    rows += rows[:9] + [(None, 1, [1.0] * 3), (500, None, [1.0] * 3), (510, 1, None), (520, 1, [1.0, None, 1.0]), (530, 1, [nan, 1.0, 1.0]), (540, 1, [inf, 1.0, 1.0]), (550, 9, [1.0] * 9), (560, 1, [])]
    rows += [(600 + i, 2, [0.5, 0.5, 0.5]) for i in range(40)] + [(700, 3, [-1.0, -1.0, -1.0]), (-10, 1, [1.0, 1.0, 0.25])]
    df = odd_vectors(spark, 3, rows)
    for shape in ((5, 5, 80, 100), (3, 2, 0, 120), (4, 5, 50, 90)):
        got = [tuple(r) for r in hard_negatives.mine(df.repartition(6), 10, *shape).collect()]
        assert len(got) == len(set(got)) and set(got) == mined(rows, 10, *shape)
    assert hard_negatives.mine(df.limit(0)).collect() == [] and hard_negatives.mine(df.where("vec_id % 100 = 7")).collect() == []


def test_large_products_stay_exact(spark):
    rows = [(0, 1, [4e4, 1e-2]), (1, 1, [4e4, 1e-2]), (2, 2, [4e4, 0.0]), (3, 2, [4e4, -1.0])]
    got = {tuple(r) for r in hard_negatives.mine(odd_vectors(spark, 2, rows)).collect()}
    assert got == mined(rows, 100, 5, 5, 80, 100) and len(got) == 2


def test_slots_answer_overlapping_windows():
    kept = hard_negatives.Slots(np.array([[90, 50, hard_negatives.NONE]]), np.array([40]), 2)
    scores = np.array([[95, 90, 88, 70, 50, 49, 41, 40, 39]])
    kept.add(np.array([0]), scores, np.arange(9))
    assert [tuple(map(int, x)) for x in zip(*kept.rows(), strict=True)] == [(0, 0, 90, 1), (0, 0, 88, 2), (0, 1, 50, 4), (0, 1, 49, 5)] and kept.lower[0] == 49


# Archives ---------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, key string, first string, payload string, value string, archive string, n string"


def odd_pages(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], PAGES)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


ODD = [(1, None, None), (2, "", ""), (3, "http://a/ \r\nX: y\t", "one"), (None, "http://b/é", "one"), (5, "http://c/", "one"), (5, "http://c/", "one"), (4, "u", "two"), (4, "u", "two"), (None, "u", "three"), (None, "u", "three"), (9, "long", "naïve €\x00\r\n\r\n" * 400_000), (-7, "v", "WARC/1.1\r\n\r\n"), (10, "w", "P*M\x18\x00\x00\x00\x00" * 9)]


@pytest.mark.parametrize("few", [True, False])
def test_pages_and_back(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(warc_archive, "BROADCAST_KEYS", 0)
        monkeypatch.setattr(warc_archive, "HOT_ROWS", 3)
    df = odd_pages(spark, ODD)
    least = {}
    for i, _, h in ODD:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = Counter()
    for i, _, h in ODD:
        first = least.get(h or "")
        kept = first is None or i == first
        want[i, len((h or "").encode()), digest(h), "response" if kept else "revisit", None if kept else first] += 1
    for part in (df, df.repartition(3)):
        assert Counter(tuple(r) for r in warc_archive.round_trip(part).collect()) == want
    assert warc_archive.round_trip(df.limit(0)).collect() == []


def test_payloads_come_back(spark, tmp_path):
    df = odd_pages(spark, ODD)
    warc_archive.write_archives(df, str(tmp_path / "a"))
    got = warc_archive.read_archives(spark, str(tmp_path / "a")).collect()
    assert Counter(bytes(r.payload).decode() for r in got if r.record_type == "response") == Counter(["", *[h for i, _, h in ODD[2:] if (i, h) not in ((None, "one"), (5, "one"))]])
    assert {r.uri for r in got} >= {"urn:page:1", "http://a/%20%0D%0AX:%20y%09", "http://b/é"} and all(r.error is None for r in got)
    held = [x.read_bytes() for x in (tmp_path / "a").glob("part-*")]
    assert held and all(x[:4] in (warc_archive.DICTIONARY, warc_archive.FRAME) for x in held if x)


def test_dictionary_leads_each_archive(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    warc_archive.write_archives(pages.repartition(3), str(tmp_path / "a"))
    held = [x.read_bytes() for x in (tmp_path / "a").glob("part-*")]
    assert len(held) == 3 and all(x.startswith(warc_archive.DICTIONARY) for x in held)
    size = int.from_bytes(held[0][4:8], "little")
    taught = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held[0][8 : 8 + size]))
    records, at = [], 8 + size
    while at < len(held[0]):  # another reader: frame by frame
        end = warc_archive._frame_end(held[0], at)
        if held[0][at : at + 4] == warc_archive.FRAME:
            records.append(taught.decompress(held[0][at:end]))
        at = end
    assert len(records) > 50 and all(r.startswith(b"WARC/1.1\r\n") for r in records)
    plain = sum(len(r.html.encode()) for r in pages.collect())
    assert sum(len(x) - size for x in held) < 0.5 * plain


def record(payload, name="r", length=None, **more):
    head = {"WARC-Type": "resource", "WARC-Record-ID": f"<urn:{name}>", "WARC-Date": warc_archive.DATE, "Content-Length": str(len(payload) if length is None else length)} | more
    return b"WARC/1.0\r\n" + "\r\n".join(f"{k}: {v}" for k, v in head.items() if v).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def test_foreign_archives_split_anywhere(spark, tmp_path):
    """Another writer's archives: no separators, a compressed dictionary or none, magic numbers inside frames, splits at any place."""
    rng = np.random.default_rng(3)
    samples = [b"a common phrase of this crawl %d and its ending" % rng.integers(100) for _ in range(300)]
    taught = zstandard.train_dictionary(2000, samples)
    lead = zstandard.ZstdCompressor().compress(taught.as_bytes())
    want = {}
    for name, pack, first in (("a", zstandard.ZstdCompressor(dict_data=taught, write_checksum=True), warc_archive.DICTIONARY + len(lead).to_bytes(4, "little") + lead), ("b", zstandard.ZstdCompressor(write_content_size=False), b"")):
        data = first
        for i in range(120):
            noise = warc_archive.FRAME.join(rng.bytes(int(n)) for n in rng.integers(0, 300, size=1 + i % 7))  # raw blocks keep these bytes
            want[f"urn:{name}{i}"] = samples[i] + noise
            data += pack.compress(record(want[f"urn:{name}{i}"], f"{name}{i}"))
        (tmp_path / f"{name}.warc").write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (1 << 27, 4001, 997):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = warc_archive.read_archives(spark, str(tmp_path)).collect()
            assert [r.error for r in got if r.error] == [] and len(got) == len(want) and {r.record_id: bytes(r.payload) for r in got} == want
        warc_archive.BROADCAST_BYTES, held = 1, warc_archive.BROADCAST_BYTES
        (tmp_path / "c.warc.zst").write_bytes(warc_archive.DICTIONARY + len(taught.as_bytes()).to_bytes(4, "little") + taught.as_bytes() + zstandard.ZstdCompressor(dict_data=taught).compress(record(b"x" * 99, "c")))
        got = warc_archive.read_archives(spark, str(tmp_path)).collect()
        warc_archive.BROADCAST_BYTES = held
        assert {r.record_id: bytes(r.payload) for r in got} == want | {"urn:c": b"x" * 99} and len(got) == len(want) + 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_faults_are_told(spark, tmp_path):
    response = lambda body, told: b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % told + body
    http = {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response"}
    cases = {
        "the record's length is another": record(b"abc", length=4),
        "warc-date is missing": record(b"abc", **{"WARC-Date": ""}),
        "no WARC header": b"HTTP/1.1 200 OK\r\n\r\n",
        "the HTTP length is another": record(response(b"abc", 4), **http),
        "the payload's digest is another": record(response(b"abc", 3), **http, **{"WARC-Payload-Digest": "sha1:" + digest("abd")}),
        "a revisit has a payload": record(response(b"abc", 3), **http | {"WARC-Type": "revisit"}),
        "no HTTP header": record(b"abc", **http),
        "a field has no name": b"WARC/1.0\r\nnothing\r\n\r\n\r\n\r\n",
    }
    pack = zstandard.ZstdCompressor(write_checksum=True)
    good, two = pack.compress(record(b"fine", "good")), pack.compress(record(b"1") + record(b"2"))
    torn = bytearray(pack.compress(record(b"torn" * 50)))
    torn[-1] ^= 1  # the checksum
    (tmp_path / "x.warc.zst").write_bytes(b"".join([good, *map(pack.compress, cases.values()), two, bytes(torn), good]) + pack.compress(record(b"cut"))[:-9])
    got = warc_archive.read_archives(spark, str(tmp_path)).collect()
    assert [bytes(r.payload) for r in got if r.error is None] == [b"fine", b"fine"]
    errors = Counter(r.error for r in got if r.error)
    assert errors["the record's length is another"] == 2 and all(errors[x] for x in cases) and errors["the archive ends inside a frame"] == 1 and len(got) == 2 + len(cases) + 3


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_hard_negatives", "op13_warc_archive"])
def test_against_sql(spark, name):
    import verify

    assert name in queries.oracle_sql() and verify.compare(spark, "/root/testdata/sf0.001", [name]) == 0
