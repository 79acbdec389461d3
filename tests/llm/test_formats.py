"""Chat formatting and WARC archives."""

import hashlib
import random
import struct

import pytest
import zstandard

from filingscope.llm import chat, warc
from filingscope.llm.store import fresh_folder
from pyspark.sql import functions as F

CONTROLS = ["<|turn|>", "<|end|>\n", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>>", "\\<|", "<\\|end|>", "\\\\", "[\\INST]", "ends with <", "ends with \\", "<<|", "<s", "", "é\n\n<pad>"]


def test_escape_is_reversible(spark):
    rows = spark.createDataFrame([(a + b,) for a in CONTROLS for b in CONTROLS], "t string")
    out = rows.withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e"))).collect()
    assert all(r.t == r.u for r in out)
    assert not any(m in r.e for r in out for m in ("<|", "</s>", "[INST]", "[/INST]", "<pad>", "<<SYS>>"))


def test_conversations_read_back(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(CONTROLS)] + [(2, 5, None, None), (2, 3, "assistant", None), (2, 3, "assistant", "b"), (None, 0, "assistant", "<|x")] + [
        (3, k, "a\nb" if k == 7 else "assistant", f"t{k}") for k in range(70)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("x"))
    formatted = chat.format_conversations(frame)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        turns = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    texts = {r.conv_id: r.formatted for r in formatted.collect()}
    assert all(got[k].formatted_chars == len(t) for k, t in texts.items())
    assert chat.read_back(chat.format_conversations(frame.limit(0))).collect() == []


def test_branches_of_trees(spark):
    """Tree 1: 1 -> (2 -> 4, 3 -> 5); tree 2 has a missing parent; tree 3 is a cycle with a tail."""
    rows = [("1", 1, None, 1.0), ("1", 2, 1, 0.0), ("1", 3, 1, 5.0), ("1", 4, 2, 9.0), ("1", 5, 3, 3.0), ("2", 7, 99, None), ("2", 8, 7, 1.0), ("3", 1, 2, 1.0), ("3", 2, 1, 1.0), ("3", 3, 2, 1.0)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    got = {}
    for r in chat.branches(messages, keep=2).collect():
        got.setdefault((r.tree, r["rank"]), []).append((-r.above, r.node))
    paths = {k: [n for _, n in sorted(v)] for k, v in got.items()}
    assert paths == {("1", 1): [1, 2, 4], ("1", 2): [1, 3, 5], ("2", 1): [7, 8]}


def test_chat_plan_is_native(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.format_conversations(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGES = [(9, "http://a/ü x\r\n", "q" * 150), (4, "http://b/", "q" * 150), (4, "http://b/", "q" * 150), (5, None, None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", "q" * 150), (10, "u", "é" * 50_000)]


@pytest.mark.parametrize("size", [2000, 2])
def test_archives_round_trip(spark, size):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES + [(k, "u", f"<p>page {k}</p>" * 9) for k in range(100, 160)]], "page_id long, url string, html string, digest string")
    path = fresh_folder(spark, "warc")
    warc.write_archives(pages, path, size)
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == pages.count() and not any(r.error for r in rows)
    held = {r.page_id: r for r in rows}
    assert (held[9].record_type, held[9].refers_to, held[9].payload_bytes, held[9].payload) == ("revisit", 4, 150, None)
    assert (held[None].record_type, held[None].refers_to) == ("revisit", 4)
    assert held[4].record_type == held[7].record_type == held[8].record_type == "response"
    assert bytes(held[10].payload).decode() == "é" * 50_000 and bytes(held[5].payload) == b""
    assert held[10].payload_digest == hashlib.sha256(("é" * 50_000).encode()).hexdigest()


def test_archives_are_bounded_by_bytes(spark):
    """Large pages close an archive early; one beyond the bound is alone in its own."""
    rng = random.Random(3)
    html = {k: rng.randbytes(150_000).hex() for k in range(12)} | {12: rng.randbytes(1_000_000).hex()}
    pages = spark.createDataFrame([(k, "u", t) for k, t in html.items()], "page_id long, url string, html string").coalesce(1)
    path = fresh_folder(spark, "warc")
    warc.write_archives(pages, path, size=1 << 20)
    rows = warc.read_archives(spark, path).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in rows} == html and not any(r.error for r in rows)
    held = {}
    for r in rows:
        held.setdefault(r.archive, []).append(r.payload_bytes)
    assert sorted(map(len, held.values())) == [1, 3, 3, 3, 3]
    assert all(len(x) == 1 or sum(x) <= 1 << 20 for x in held.values())


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = fresh_folder(spark, "warc")
    warc.write_archives(pages, path)
    assert warc.read_archives(spark, path).filter("record_type IS NOT NULL").collect() == []


def _archive(records):
    return b"".join(warc.archive(records))


def test_reader_validates():
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse(good)["payload"] == b"payload"
    for bad in (good.replace(b"WARC/1.1", b"WARP/1.1"), good.replace(b"Content-Length: 7\r\n", b"Content-Length: 8\r\n"), good[:-1], good.replace(b"payload", b"pay1oad"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"WARC-Type: response", b"WARC-Type response")):
        if bad != good:
            with pytest.raises(warc.Broken):
                warc.parse(bad)
    many = [warc.record(k, "u", b"payload" * k, hashlib.sha256(b"payload" * k).hexdigest(), None) for k in range(40)]
    data = _archive(many)
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY and list(warc.frames(data)) == many
    size = struct.unpack_from("<I", data, 4)[0]
    squeezed = zstandard.ZstdCompressor().compress(data[8:8 + size])
    assert list(warc.frames(struct.pack("<II", warc.DICTIONARY, len(squeezed)) + squeezed + data[8 + size:])) == many
    for cut in (data[:-3], data[:4], data + b"trash123", data[8 + size:]):
        with pytest.raises(warc.Broken):
            list(warc.frames(cut))
