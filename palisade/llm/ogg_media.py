"""Ogg media columns: write a byte payload as 8-bit samples in a multiplexed Ogg stream, and read it back.

Writing deals the samples out, packet by packet, to `STREAMS` logical streams; each
starts with a header packet, packets are laced into 255-byte segments, may run on over
page ends, and every page has its granule position (samples of its stream so far) and
checksum. Reading verifies each page's checksum and sequence number, demultiplexes by
serial number, reassembles packets from lacing values and puts the streams' packets back
in the order of time: a page's granule position is where the last packet that ends on it stops,
packets before it are counted back from there, and the header's rate turns samples into time.

An empty table gives an empty table, a text may have any length (packets are bounded), and other columns are not read.
Null or empty texts are stored as 192 blanks. Equal texts give equal bytes, as serial
numbers come from the payload. Damaged bytes raise ValueError: no row is lost silently.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import read, small_batches

UNIT, PACKET, RATE, STREAMS, PAGE_SEGMENTS = 192, 960, 8000, 2, 32
_MAGIC, _HEADER = b"\x01PCM8", struct.Struct("<5sBBIQ")  # magic, stream, streams, rate, samples
_PAGE = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from 0: the mirror image of zlib's."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing))
    crc = page_checksum(head + lacing + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + lacing + body


def _pages(packets: list[bytes], serial: int) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream; the first packet is its header, alone on its page."""
    first = packets[0]
    out = [(0, _page(2 | (4 if len(packets) == 1 else 0), 0, serial, 0, bytes([len(first)]), first))]
    lacing, body, granule, done, carried = bytearray(), bytearray(), -1, 0, False
    segments = [(p[i : i + 255], i + 255 > len(p), len(p)) for p in packets[1:] for i in range(0, len(p) + 1, 255)]
    for at, (piece, ends, size) in enumerate(segments):
        lacing.append(len(piece))
        body += piece
        if ends:
            done += size
            granule = done
        last = at == len(segments) - 1
        if len(lacing) == PAGE_SEGMENTS or last:
            out.append((done, _page((1 if carried else 0) | (4 if last else 0), granule, serial, len(out), bytes(lacing), bytes(body))))
            lacing, body, granule, carried = bytearray(), bytearray(), -1, not ends
    return out


def write_ogg(payload: bytes) -> bytes:
    base = zlib.crc32(payload)
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    pages = []
    for s in range(STREAMS):
        own = packets[s::STREAMS]
        head = _HEADER.pack(_MAGIC, s, STREAMS, RATE, sum(map(len, own)))
        pages.append(_pages([head, *own], (base + s * 0x9E3779B1) & 0xFFFFFFFF))
    heads = [p[0][1] for p in pages]
    rest = sorted(((g, s, i) for s, p in enumerate(pages) for i, (g, _) in enumerate(p[1:], 1)), key=lambda x: (x[2], x[1]))
    return b"".join(heads + [pages[s][i][1] for _, s, i in rest])


def read_ogg(media: bytes) -> tuple[bytes, str]:
    """The payload, and a line of what the streams hold: streams, pages, packets, samples, last time in microseconds."""
    at, pages, streams = 0, 0, {}
    while at < len(media):
        magic, version, kind, granule, serial, number, crc, n = _PAGE.unpack_from(media, at)
        body = at + 27 + n
        lacing = media[at + 27 : body]
        end = body + sum(lacing)
        if magic != b"OggS" or version or end > len(media):
            raise ValueError(f"no page at byte {at}")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at byte {at}")
        s = streams.setdefault(serial, {"packets": [], "part": b"", "next": 0, "ends": [], "first": bool(kind & 2), "last": False})
        if number != s["next"] or s["last"] or not s["first"] or bool(kind & 1) != bool(s["part"]):
            raise ValueError(f"page order at byte {at}")
        s["next"], s["last"] = number + 1, bool(kind & 4)
        pos, start, ended = body, body, False
        for size in lacing:
            pos += size
            if size < 255:
                s["packets"].append(s["part"] + media[start:pos])
                s["part"], start, ended = b"", pos, True
        if start < pos:
            s["part"] += media[start:pos]
        if (granule >= 0) != ended:
            raise ValueError(f"granule position at byte {at}")
        if ended:
            s["ends"].append((granule, len(s["packets"])))
        pages, at = pages + 1, end
    timed, samples, packets, last_us = [], 0, 0, 0
    for s in streams.values():
        if s["part"] or not s["last"]:
            raise ValueError("a stream breaks off")
        magic, index, n_streams, rate, total = _HEADER.unpack(s["packets"][0])
        if magic != _MAGIC or n_streams != len(streams):
            raise ValueError("stream header")
        begins, before, known = [], 0, 1
        for granule, count in s["ends"]:  # a page's position is where the last packet that ends on it stops: count back from there
            own, stop = [], granule
            for p in reversed(s["packets"][known:count]):
                stop -= len(p)
                own.append(stop)
            if stop != before:
                raise ValueError("granule position does not fit the samples")
            begins += reversed(own)
            before, known = granule, max(known, count)
        if before != total or known != len(s["packets"]):
            raise ValueError("samples are missing")
        timed += [(b, index, p) for b, p in zip(begins, s["packets"][1:])]
        samples, packets = samples + before, packets + len(s["packets"])
        last_us = max(last_us, before * 1_000_000 // rate)
    timed.sort(key=lambda x: x[:2])
    return b"".join(p for _, _, p in timed), f"streams={len(streams)};pages={pages};packets={packets};samples={samples};end_us={last_us}"


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT))


@F.pandas_udf(T.BinaryType())
def encode_media(text: pd.Series) -> pd.Series:
    """A column of texts as Ogg files."""
    return pd.Series([write_ogg(padded(t)) for t in text], dtype=object)


@F.pandas_udf(T.StructType().add("payload", T.BinaryType()).add("feature", T.StringType()))
def decode_media(media: pd.Series) -> pd.DataFrame:
    """A column of Ogg files as payloads and features."""
    rows = [read_ogg(bytes(m)) for m in media]
    return pd.DataFrame({"payload": pd.Series([r[0] for r in rows], dtype=object), "feature": pd.Series([r[1] for r in rows], dtype=object)})


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    media = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), encode_media("text").alias("media"))
    back = media.withColumn("back", decode_media("media"))
    return back.select(
        "doc_id", "n_bytes",
        F.octet_length("back.payload").cast("long").alias("payload_bytes"),
        F.sha2("back.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("back.payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("back.feature").alias("feature"),
    )
