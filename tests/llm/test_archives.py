"""Archives written and read back, whole and damaged."""

import base64
import glob
import gzip
import hashlib
import random
import uuid

import pyarrow as pa
import pytest

from passel.llm.warc import PARTS, _row, read_archives, salvage, write_archives

PAGES = "page_id long, url string, html string, payload string, digest string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", "d") for i, u, h in rows], PAGES)


ROWS = [
    (1, "http://a/\r\nb", "a" * 1000),
    (2, None, "a" * 1000),
    (3, "u", "a" * 999),
    (4, "u", "a" * 999),
    (5, "u", None),
    (None, "u", "a" * 1000),
    (6, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\x1f"),
    (7, "é", "é" * 600),
    (8, "é", "é" * 600),
    (8, "é", "é" * 600),
]


def written(spark, tmp_path, rows, compression="gzip", **options):
    write_archives(pages_of(spark, rows).coalesce(1), f"{tmp_path}/out", compression=compression, **options)
    return f"{tmp_path}/out"


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    rows = read_archives(spark, written(spark, tmp_path, ROWS, compression, records_per_file=4)).collect()
    assert len({r.archive for r in rows}) == 3 and all(r.record_type != "gap" for r in rows)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows), key=repr)

    def want(i, html):
        data = (html or "").encode()
        refers = {1: 2, 7: 8}.get(i)
        return i, "revisit" if refers else "response", refers, len(data), hashlib.sha1(data).hexdigest()

    assert got == sorted((want(i, h) for i, _, h in ROWS), key=repr)
    assert {r.page_id: r.target_uri for r in rows if r.page_id in (1, 2, 7)} == {1: "http://a/b", 2: None, 7: "é"}
    assert all(bytes(r.payload).decode() == (dict((i, h) for i, _, h in ROWS)[r.page_id] or "") for r in rows if r.record_type == "response")


def test_no_pages(spark, tmp_path):
    assert read_archives(spark, written(spark, tmp_path, [])).count() == 0


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    """One archive plain, as one member, and as a member for each record."""
    chance = random.Random(1)
    texts = ["".join(chance.choice("abcdefgh <>é") for _ in range(chance.randrange(2000))) for _ in range(30)]
    folder = written(spark, tmp_path_factory.mktemp("warc"), [(i, "u", t) for i, t in enumerate(texts)], "none")
    (file,) = glob.glob(f"{folder}/part-*")
    with open(file, "rb") as opened:
        plain = opened.read()
    parts = [*salvage(plain)]
    assert len(parts) == 30 and plain[parts[0].start : parts[0].end].endswith(b"\r\n\r\n")
    members = b"".join(gzip.compress(plain[p.start : p.end]) for p in parts)
    return {"plain": plain, "one member": gzip.compress(plain), "members": members}


def ids(parts):
    return [p.fields.get("x-page-id") for p in parts if p.kind != "gap"]


@pytest.mark.parametrize("form", ["plain", "one member", "members"])
def test_whole_archives(archives, form):
    parts = [*salvage(archives[form])]
    assert len(set(ids(parts))) == 30 and len(parts) == 30


@pytest.mark.parametrize("form", ["plain", "members"])
def test_later_records_survive_damage(archives, form):
    """A spoilt byte costs one record or two, a lost or foreign stretch those that it touches; gaps are logged."""
    data, chance, whole = archives[form], random.Random(5), ids(salvage(archives[form]))
    for _ in range(60):
        at = chance.randrange(len(data))
        spoilt = bytearray(data)
        spoilt[at] ^= chance.randrange(1, 256)
        parts = [*salvage(bytes(spoilt))]
        known = [i for i in ids(parts) if i in set(whole)]
        assert len(known) >= 28 and all(p.reason for p in parts if p.kind == "gap")
        for changed in (data[:at] + data[at + 50 :], data[:at] + b"WARC/1.1\r\n\x1f\x8b\x08junk" + data[at:]):
            parts = [*salvage(changed)]
            assert len({*ids(parts)} & {*whole}) >= 27


def test_bytes_are_accounted_for(archives):
    """Of a plain archive every byte is in a record or in a gap."""
    data = b"junk" + archives["plain"][:3000] + b"\0" * 500 + archives["plain"][3500:]
    at = 0
    for part in salvage(data):
        start = part.member + part.start
        assert start == at
        at = part.member + part.end
    assert at == len(data)


def test_broken_member_gives_what_it_held(archives):
    data = archives["one member"]
    cut = data[: len(data) // 2]
    parts = [*salvage(cut + archives["members"])]
    assert len(ids(parts)) >= 30 + 10 and any(p.kind == "gap" for p in parts)


def test_no_bytes():
    assert [*salvage(b"")] == [] and [p.kind for p in salvage(b"nothing here")] == ["gap"]


@pytest.fixture(scope="module")
def own_form(spark, tmp_path_factory):
    """A gzipped file as the writer makes it."""
    chance = random.Random(1)
    texts = ["".join(chance.choice("abcdefgh <>é") for _ in range(chance.randrange(2000))) for _ in range(30)]
    folder = written(spark, tmp_path_factory.mktemp("warc"), [(i, "u", t) for i, t in enumerate(texts)])
    (file,) = glob.glob(f"{folder}/**/part-*", recursive=True)
    with open(file, "rb") as opened:
        return opened.read()


def test_written_form_is_a_member_for_each_record(own_form):
    parts = [*salvage(own_form)]
    assert len(parts) == 30 and len({p.member for p in parts}) == 30
    whole = gzip.decompress(own_form)
    assert len([*salvage(whole)]) == 30


def test_later_records_survive_damage_of_the_written_form(own_form):
    chance, whole = random.Random(5), {*ids(salvage(own_form))}
    for _ in range(60):
        at = chance.randrange(len(own_form))
        spoilt = bytearray(own_form)
        spoilt[at] ^= chance.randrange(1, 256)
        parts = [*salvage(bytes(spoilt))]
        assert len({*ids(parts)} & whole) >= 28
        # Places of a broken member are places of the file, within the damaged record.
        for p in parts:
            if "broken" in p.reason:
                assert p.member == 0 and 0 < p.start <= p.end <= len(own_form) and str(p.end - p.start) in p.reason
        assert len({*ids(salvage(own_form[:at] + own_form[at + 50 :]))} & whole) >= 27


def test_the_range_of_a_broken_member(archives):
    """The bytes from the damage to the next member, not an empty range."""
    first = gzip.compress(random.Random(2).randbytes(200000))
    data = first[:150000] + archives["members"]
    (gap,) = [p for p in salvage(data) if "broken" in p.reason]
    assert gap.end == 150000 and 100000 < gap.start <= gap.end


def test_files_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "u", f"{i} " * 2000) for i in range(20)]
    found = read_archives(spark, written(spark, tmp_path, rows, file_bytes=30000)).collect()
    assert sorted(r.page_id for r in found) == list(range(20))
    files = {}
    for r in found:
        files[r.archive] = files.get(r.archive, 0) + r.end - r.start
    assert len(files) > 3 and max(files.values()) <= 30000


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_a_very_long_url(spark, tmp_path, compression):
    """A header far longer than usual is read whole, and a spoilt one costs its record only."""
    url = "data:text/html;base64," + "QUJD" * 50000
    folder = written(spark, tmp_path, [(1, "u", "a"), (2, url, "b" * 50), (3, "v", "c")], compression)
    rows = {r.page_id: r for r in read_archives(spark, folder).collect()}
    assert sorted(rows) == [1, 2, 3] and rows[2].target_uri == url and bytes(rows[2].payload) == b"b" * 50


@pytest.mark.parametrize("mark", ["\u2028", "\u0085", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\u2029"])
def test_a_url_forges_no_field(spark, tmp_path, mark):
    """Characters that some take for line ends are part of the url."""
    url = f"http://a/{mark}WARC-Type: revisit{mark}X-Refers-To-Page-Id: 9{mark}"
    (row,) = read_archives(spark, written(spark, tmp_path, [(1, url, "a" * 2000)])).collect()
    assert (row.record_type, row.refers_to, row.target_uri, row.payload_bytes) == ("response", None, url, 2000)


def record(*fields, block=b"abc", length=None):
    lines = ["WARC/1.1", *fields, f"Content-Length: {len(block) if length is None else length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_lengths_and_identifiers_of_any_size():
    good = record("WARC-Type: response", "X-Page-Id: 7")
    for length in ("9" * 5000, "9" * 18, "-1", "\u0663", "1_0", "+3", ""):
        parts = [*salvage(record("WARC-Type: response", length=length) + good)]
        assert [p.kind for p in parts] == ["gap", "response"], length
    for number, want in (("9" * 19, None), ("9" * 5000, None), (str(2**63 - 1), 2**63 - 1), (str(-(2**63)), -(2**63)), ("--5", None), ("5-", None)):
        (part,) = salvage(record("WARC-Type: response", f"X-Page-Id: {number}"))
        assert _row("a", part)[5] == want


def test_digests_of_other_archives():
    """Base 32 and hex of either case, other digests, and those that no reader knows."""
    raw = hashlib.sha1(b"abc").digest()
    claims = [
        "sha1:" + base64.b32encode(raw).decode(), "SHA1:" + base64.b32encode(raw).decode().lower(), "sha1:" + raw.hex().upper(), raw.hex(),
        "sha256:" + hashlib.sha256(b"abc").hexdigest(), "md5:" + hashlib.md5(b"abc").hexdigest(), "crc32c:00",
    ]
    for claim in claims:
        (part,) = salvage(record("WARC-Type: response", f"WARC-Payload-Digest: {claim}"))
        assert part.kind == "response" and _row("a", part)[9] == raw.hex(), claim
    for claim in ("sha1:" + base64.b32encode(hashlib.sha1(b"x").digest()).decode(), "sha1:!!", "sha1:é", "md5:" + raw.hex()):
        (part,) = salvage(record("WARC-Type: response", f"WARC-Payload-Digest: {claim}"))
        assert part.reason == "payload of another digest", claim
    (part,) = salvage(record("WARC-Type: revisit", "WARC-Payload-Digest: sha1:" + base64.b32encode(raw).decode()))
    assert _row("a", part)[9] == raw.hex()


def test_mandatory_fields(spark, tmp_path):
    """Every record has a name and a time; a revisit names the record that it refers to."""
    folder = written(spark, tmp_path, ROWS, "none", date="2025-01-31T00:00:00Z")
    (file,) = glob.glob(f"{folder}/part-*")
    with open(file, "rb") as opened:
        parts = [*salvage(opened.read())]
    assert all(p.fields["warc-date"] == "2025-01-31T00:00:00Z" for p in parts)
    names = {(p.fields["warc-record-id"]): p.fields.get("x-page-id") for p in parts}
    assert len(names) == len(ROWS) - 1 and all(uuid.UUID(n.strip("<>").removeprefix("urn:uuid:")).version == 5 for n in names)
    revisits = [p for p in parts if p.kind == "revisit"]
    assert revisits and all(names[p.fields["warc-refers-to"]] == p.fields["x-refers-to-page-id"] for p in revisits)


@pytest.mark.parametrize("form", ["plain", "one member", "members"])
def test_no_damage_raises(archives, form):
    """Any bytes end in records and gaps, and every part makes a row."""
    data, chance = archives[form], random.Random(9)
    for _ in range(60):
        spoilt = bytearray(data)
        for _ in range(chance.randrange(1, 40)):
            at = chance.randrange(len(spoilt))
            spoilt[at : at + chance.randrange(3)] = chance.randbytes(chance.randrange(4))
        rows = [_row("a", p) for p in salvage(bytes(spoilt))]
        assert rows and pa.Table.from_pylist([dict(zip(PARTS.names, r)) for r in rows], schema=PARTS)
