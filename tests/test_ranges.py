"""FASTQ pairs read by many tasks in step, against one pass over both files."""

import gzip
import random
import struct
import zlib

import pytest

from ribostrand.sources import ranges as R
from ribostrand.sources import reads as S


def blocked(data: bytes, size: int) -> bytes:
    """Block gzip: members of so many bytes that state their own size, and an empty one at the end."""
    out = b""
    for at in [*range(0, len(data), size), len(data)]:
        part = data[at : at + size]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        out += head + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def record(rng, i, longest):
    n = rng.randint(1, longest)
    return f"@read{i} {'x' * rng.randint(0, 9)}\n{''.join(rng.choice('ACGTN') for _ in range(n))}\n+\n{''.join(rng.choice('@+IJ#') for _ in range(n))}\n"


def texts(seed, n1=700, n2=700):
    rng = random.Random(seed)
    return "".join(record(rng, i, 20) for i in range(n1)), "".join(record(rng, i, 150) for i in range(n2))


def plain(a, b):
    rows = [[t.split("\n")[k::4] for k in range(4)] for t in (a, b)]
    n = min(len(r[3]) for r in rows)
    return [(i, rows[0][0][i].split()[0][1:], rows[0][1][i], rows[1][1][i], rows[0][3][i], rows[1][3][i]) for i in range(n)]


def put(path, text, how):
    raw = text.encode()
    path.write_bytes(raw if how == "plain" else blocked(raw, 700) if how == "blocked" else gzip.compress(raw[:5000]) + gzip.compress(raw[5000:]))


def read(spark, p1, p2, split):
    df = S.read_fastq(spark, str(p1), str(p2), split_bytes=split)
    return [tuple(r) for r in df.orderBy("pair_id").select("pair_id", "identifier", "r1", "r2", "r1_qual", "r2_qual").collect()], df.rdd.getNumPartitions()


@pytest.mark.parametrize(("how1", "how2"), [("plain", "plain"), ("blocked", "blocked"), ("plain", "blocked")])
def test_ranges_give_the_pairs_of_one_pass(spark, tmp_path, how1, how2):
    """Records of R2 are several times longer than those of R1, so the same numbers stand far apart."""
    a, b = texts(1)
    names = [tmp_path / f"{k}.fastq{'.gz' if h == 'blocked' else ''}" for k, h in enumerate((how1, how2))]
    put(names[0], a, how1)
    put(names[1], b, how2)
    wanted = plain(a, b)
    for parts in (64, 7):
        got, tasks = read(spark, *names, -(-R.file_size(str(names[0])) // parts))
        assert got == wanted and tasks > parts // 3
    assert read(spark, *names, 1 << 30) == (wanted, 1)


def test_a_gzip_stream_is_one_task(spark, tmp_path):
    a, b = texts(2, 300, 300)
    for k, t in enumerate((a, b)):
        put(tmp_path / f"{k}.fastq.gz", t, "stream")
    assert not R.is_splittable(str(tmp_path / "0.fastq.gz"))
    assert read(spark, tmp_path / "0.fastq.gz", tmp_path / "1.fastq.gz", 1000) == (plain(a, b), 1)


@pytest.mark.parametrize("short", ["r1", "r2"])
def test_files_of_unequal_length(spark, tmp_path, short):
    """The pairs end with the shorter file, and with an empty line in either."""
    a, b = texts(3, *((250, 400) if short == "r1" else (400, 250)))
    (tmp_path / "a.fastq").write_text(a)
    (tmp_path / "b.fastq").write_text(b)
    got, tasks = read(spark, tmp_path / "a.fastq", tmp_path / "b.fastq", 1500)
    assert got == plain(a, b) and len(got) == 250 and tasks > 5
    heads = b.split("\n")
    (tmp_path / "b.fastq").write_text("\n".join(heads[: 4 * 120]) + "\n\n" + "\n".join(heads[4 * 120 :]))
    got, _ = read(spark, tmp_path / "a.fastq", tmp_path / "b.fastq", 1500)
    assert got == plain(a, b)[:120]


def test_identifiers_are_compared(spark, tmp_path):
    a, b = texts(4, 200, 200)
    (tmp_path / "a.fastq").write_text(a)
    (tmp_path / "b.fastq").write_text(b.replace("@read150 ", "@other "))
    assert len(read(spark, tmp_path / "a.fastq", tmp_path / "b.fastq", 700)[0]) == 200
    with pytest.raises(Exception, match="record 150"):
        S.read_fastq(spark, f"{tmp_path}/a.fastq", f"{tmp_path}/b.fastq", strict=True, split_bytes=700).collect()


def test_several_pairs_and_channels(spark, tmp_path):
    """A small pair, a large one and an empty one; numbers of pairs do not clash."""
    large, small = texts(5, 300, 300), texts(6, 3, 3)
    for name, (a, b) in {"l": large, "s": small, "e": ("", "")}.items():
        (tmp_path / f"{name}1.fastq").write_text(a)
        (tmp_path / f"{name}2.fastq").write_text(b)
    files = [[f"{tmp_path}/{n}{k}.fastq" for n in "sle"] for k in (1, 2)]
    df = S.read_fastq(spark, *files, split_bytes=2000)
    rows = df.collect()
    assert len({r["pair_id"] for r in rows}) == len(rows) == 303
    assert sorted(r["r2"] for r in rows) == sorted(x[3] for x in plain(*large) + plain(*small))
    both = S.read_channels(spark, (f"{tmp_path}/l1.fastq", f"{tmp_path}/l2.fastq"), (f"{tmp_path}/s1.fastq", f"{tmp_path}/s2.fastq"), split_bytes=2000)
    counts = {r["channel"]: (r["count"], r["forced_mask"]) for r in both.groupBy("channel", "forced_mask").count().collect()}
    assert counts == {"treated": (300, "RRRY"), "untreated": (3, "YYYR")}


@pytest.mark.parametrize("how", ["plain", "blocked"])
def test_every_range_owns_its_records(tmp_path, how):
    """Ranges of any size, most of them without a record, hold each record once and in order."""
    _, text = texts(7, 0, 60)
    path = tmp_path / f"x.fastq{'.gz' if how == 'blocked' else ''}"
    path.write_bytes(text.encode() if how == "plain" else blocked(text.encode(), 41))
    heads = text.split("\n")[0:-1:4]
    size = R.file_size(str(path))
    for step in (13, 37, 150, 1000, size):
        got = [h for at in range(0, size, step) for h in R.Records(str(path), at, at + step).take(1000)[0]]
        assert got == heads


def test_estimates(tmp_path):
    text, _ = texts(8, 5000, 0)
    for how, name in (("plain", "a.fastq"), ("stream", "b.fastq.gz"), ("blocked", "c.fastq.gz")):
        put(tmp_path / name, text, how)
        assert 4000 < S.estimated_pairs(str(tmp_path / name)) < 6200
    (tmp_path / "none.fastq").write_text("")
    assert S.estimated_pairs(str(tmp_path / "none.fastq")) == 0
