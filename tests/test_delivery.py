"""Validation, timelines, progress, engines, sources, settings, command line, stream."""

from __future__ import annotations

import io
import json
import os
import random
import sys
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import wer
from lectern.operators import container, delivery, engines, narration, progress
from lectern.plans import book, cli, config
from lectern.sources import audio, books
from lectern.streaming import drop

NORMALIZED = [("Hello, World!", "hello world"), ("[excited] Hello there!", "hello there"), ("(laughing) Ha ha", "ha ha"), ("“Hello”", "hello"), ("  too   many   spaces  ", "too many spaces"), ("I can't believe it's real", "i can't believe it's real")]


def test_comparable(spark):
    rows = spark.createDataFrame(NORMALIZED, "a string, b string").select(wer.comparable(F.col("a")), "b").collect()
    assert [r[0] for r in rows] == [r[1] for r in rows]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_against_the_full_table():
    rng = random.Random(1)
    for _ in range(150):
        a = [rng.choice("abcde") for _ in range(rng.randrange(0, 40))]
        b = list(a) if rng.random() < 0.5 else [rng.choice("abcde") for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 6)):
            if b:
                b[rng.randrange(len(b))] = rng.choice("abcdefg")
                del b[rng.randrange(len(b))]
        s, d, i, h = wer.align(a, b)
        assert s + d + i == plain_distance(a, b) == wer.distance("".join(a), "".join(b))
        assert s + d + h == len(a) and s + i + h == len(b)


def test_pairs_side_by_side():
    """Tables shared by pairs of all lengths and bands give what each pair gives alone."""
    rng, pairs = random.Random(7), []
    for _ in range(120):
        a = [rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 5, 60, 200]))]
        b = [x for x in a if rng.random() > rng.choice([0, 0.1, 0.6])]
        pairs.append((a, b + [rng.choice("xyz") for _ in range(rng.randrange(0, 40))]))
    assert wer.align_many(pairs) == [wer.align(a, b) for a, b in pairs]
    texts = [("".join(a), "".join(b)) for a, b in pairs]
    assert wer.distance_many(texts) == [plain_distance(a, b) for a, b in texts]
    assert all(s + d + i == plain_distance(a, b) for (s, d, i, _), (a, b) in zip(wer.align_many(pairs), pairs, strict=True))


@pytest.mark.parametrize(
    ("reference", "hypothesis", "counts"),
    [("hello world", "hello world", (0, 0, 0, 2)), ("hello world", "hello duck", (1, 0, 0, 1)), ("the quick brown fox", "the brown fox", (0, 1, 0, 3)), ("hello world", "hello beautiful world", (0, 0, 1, 2))],
)
def test_word_pairs(reference, hypothesis, counts):
    assert wer.align(reference.split(), hypothesis.split()) == counts


def checked(spark):
    chapters = spark.createDataFrame([("b", 0, "One", "a b c d"), ("b", 1, "A very long chapter title that goes on and on", "a b c d"), ("b", 2, "Empty", ""), ("b", 3, "Silent", "x y"), ("b", 4, "Gone", "z")], "book_id string, chapter_index int, title string, text string")
    heard = spark.createDataFrame([("b", 0, "a b c d", 2.0), ("b", 1, "a b x", 2.0), ("b", 2, "noise", 1.0), ("b", 3, " ", 1.0)], "book_id string, chapter_index int, transcript string, duration_seconds double")
    return delivery.validate(chapters, heard)


def test_validation(spark):
    rows = {r["chapter_index"]: r for r in checked(spark).collect()}
    assert set(rows) == {0, 1, 2, 3}
    assert (rows[0]["wer"], rows[0]["flagged"], rows[0]["flag_reason"]) == (0.0, False, "")
    assert (rows[1]["wer"], rows[1]["substitutions"], rows[1]["deletions"], rows[1]["flag_reason"]) == (0.5, 1, 1, "WER 50.0% exceeds threshold 15% (1S/1D/0I)")
    assert (rows[2]["wer"], rows[2]["cer"], rows[2]["flagged"], rows[2]["hypothesis_words"]) == (0.0, 0.0, False, 0)
    assert (rows[3]["wer"], rows[3]["wil"], rows[3]["deletions"], rows[3]["flagged"], rows[3]["transcript"]) == (1.0, 1.0, 2, True, "")
    total = delivery.summary(checked(spark)).first()
    assert (total["total_reference_words"], total["total_errors"], total["flagged_chapters"], total["aggregate_wer"]) == (10, 4, 2, 0.4)


def test_report(spark):
    text = delivery.report(spark.createDataFrame([("b", "Alice")], "book_id string, title string"), checked(spark)).first()["value"].split("\n")
    assert text[0] == "=" * 70 and text[1] == "  WER Validation Report: Alice" and text[5] == "  Aggregate WER : 40.0%" and text[9] == "  Flagged       : 2 / 4 chapters"
    assert "    2  A very long chapter title that go..  50.0%  42.9%       4 ***" in text
    assert text[-2] == "  Quality: Unacceptable — major issues; check TTS engine and text normalization." and "    Ch 4: Empty transcript — TTS may have produced silence." in text


def test_timeline_rounds_half_to_even(spark):
    rows = spark.createDataFrame([("b", 0, "A", 0.0005), ("b", 1, "B", 0.0015), ("b", 2, "C", 1.25)], "book_id string, chapter_index int, title string, duration_seconds double")
    assert [(r["start_ms"], r["end_ms"]) for r in delivery.timeline(rows).orderBy("chapter_index").collect()] == [(0, 0), (0, 2), (2, 1252)]


def test_progress(spark, tmp_path):
    path = str(tmp_path / "events")
    chunks = spark.createDataFrame([("b", 0, 0), ("b", 0, 1), ("c", 0, 0)], "book_id string, chapter_index int, chunk_index int")
    assert progress.pending_chunks(chunks, progress.load(spark, path)).count() == 3
    done = chunks.filter("book_id = 'b' and chunk_index = 0").withColumns({"state_key": F.lit("k"), "audio_path": F.lit("x.wav")})
    progress.append(progress.marked(done, "chunk"), path)
    events = progress.load(spark, path)
    assert progress.pending_chunks(chunks, events).count() == 2
    assert progress.pending_chunks(chunks, events, spark.createDataFrame([("other",)], "path string")).count() == 3
    keyed = spark.createDataFrame([("b", "changed")], "book_id string, state_key string")
    assert progress.pending_chunks(chunks, progress.valid(events, keyed)).count() == 3
    status = progress.progress(spark.createDataFrame([("b", 3, 2), ("z", 0, 0)], "book_id string, total_chapters int, total_chunks int"), events).orderBy("book_id").collect()
    assert [(r["completed_chunks"], r["percent"]) for r in status] == [(1, 0.0), (0, 0.0)]
    progress.reset(spark, path)
    assert progress.load(spark, path).count() == 0


def test_wav_round_trip():
    x = np.array([0.0, 0.5, -0.5, 2.0, -2.0], np.float32)
    back, rate = audio.samples(audio.wav_bytes(x, 8000))
    assert rate == 8000 and np.allclose(back, np.clip(x, -1, 1), atol=1e-3)
    quiet = np.concatenate((np.zeros(8000), np.full(100, 0.5), np.zeros(100))).astype(np.float32)
    assert len(audio.trim_silence(quiet, 8000)) == 200
    assert len(audio.resample(x, 8000, 16000)) == 10 and abs(float(np.sqrt(np.mean(audio.normalize_level(np.full(50, 0.01, np.float32)) ** 2))) - 10 ** (-19 / 20)) < 1e-4


def test_engines(spark):
    class Broken(engines.SilentEngine):
        closed = []

        def synthesize(self, text, emotion, intensity, speed):
            raise OSError("no voice")

    s = "array<struct<text:string,emotion:string,intensity:double,speed:double,pause_samples:int>>"
    plan = spark.createDataFrame([("b", 0, 0, [("x" * 30, "sad", 0.5, 1.0, 100)])], f"book_id string, chapter_index int, chunk_index int, sentences {s}")
    good, bad = engines.synthesize(plan).first(), engines.synthesize(plan, factory=Broken).first()
    assert good["duration_seconds"] == bad["duration_seconds"] == (48_000 + 100) / 24_000 and (good["failed"], bad["failed"]) == (0, 1)
    with pytest.raises(ValueError, match="unknown engine"):
        engines.get_engine("none")
    waits = []
    with pytest.raises(OSError):
        engines.with_retries(lambda: (_ for _ in ()).throw(OSError("x")), 3, engines.linear_delay, waits.append)
    assert waits == [2.0, 4.0] and [engines.doubling_delay(k) for k in (1, 5, 9)] == [2.0, 32.0, 60.0]


def test_refinement(spark):
    replies = spark.createDataFrame([("b", 0, '```json\n[{"index": 1, "emotion": "Sad", "intensity": 3}, {"emotion": "sad"}, {"index": 2, "emotion": "odd"}]\n```'), ("c", 0, "broken"), ("d", 0, None)], "book_id string, chapter_index int, reply string")
    got = [tuple(r) for r in engines.refinement_replies(replies).orderBy("sentence_index").collect()]
    assert got == [("b", 0, 1, "sad", 7000), ("b", 0, 2, "neutral", 3000)]


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text('engine: tone  # voice\nprocessing:\n  chunk_chars: 300\n  unknown: 1\nemotion:\n  enabled: true\n  max_intensity: 0.5\nbook:\n  title: "A: B"\n')
    got = config.load(str(path), {"processing": {"segmenter": "other"}}, env={"OPENAI_API_KEY": "k1"})
    assert (got.engine, got.processing.chunk_chars, got.processing.segmenter, got.emotion.enabled, got.emotion.max_intensity, got.emotion.api_key, got.book.title) == ("tone", 300, "other", True, 0.5, "k1", "A: B")
    assert config.load(env={"OPENAI_API_KEY": "a", "EMOTION_LLM_API_KEY": "b"}).emotion.api_key == "b"
    assert config.load(env={}) == config.Settings()


def epub(nav: bool) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        toc = '<item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' if nav else ""
        z.writestr("OPS/p.opf", f"""<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> My Epub </dc:title><dc:language>en</dc:language><meta name="cover" content="img"/></metadata>
            <manifest><item id="img" href="pic.png" media-type="image/png"/><item id="a" href="t/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="t/b.xhtml" media-type="application/xhtml+xml"/>{toc}</manifest>
            <spine><itemref idref="b"/><itemref idref="a"/></spine></package>""")
        z.writestr("OPS/t/a.xhtml", "<html><body><h1>Alpha</h1><p>First text.</p></body></html>")
        z.writestr("OPS/t/b.xhtml", "<html><body><p>Second text.</p></body></html>")
        z.writestr("OPS/pic.png", b"png")
        if nav:
            z.writestr("OPS/nav.xhtml", '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="t/a.xhtml#x">One</a><ol><li><a href="t/b.xhtml">Two</a></li></ol></li></ol></nav></body></html>')
    return out.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "a_tale-of.txt").write_bytes(b"\xef\xbb\xbfChapter 1\nHello there. General!\n")
    (tmp_path / "latin.TXT").write_bytes("Caf\xe9".encode("latin-1"))
    (tmp_path / "toc.epub").write_bytes(epub(True))
    (tmp_path / "spine.epub").write_bytes(epub(False))
    found = books.files(spark, str(tmp_path))
    plain = {r["title"]: r["text"] for r in books.text_books(found).collect()}
    assert plain == {"A Tale Of": "Chapter 1\nHello there. General!\n", "Latin": "Café"}
    packed = books.epub_books(found)
    assert {(r["title"], r["author"], r["language"], r["cover_id"]) for r in packed.collect()} == {("My Epub", "Unknown", "en", "img")}
    assert {(r["name"], r["cover_ext"], bytes(r["cover"])) for r in books.epub_covers(packed).collect()} == {("pic.png", "png", b"png")}
    chapters = sorted((r["chapter_index"], r["title"], r["text"]) for r in books.epub_chapters(packed).collect())
    assert chapters == [(0, "Chapter 1", "Second text."), (0, "One", "Alpha\n\nFirst text."), (1, "Alpha", "Alpha\n\nFirst text."), (1, "Two", "Second text.")]
    (tmp_path / "bad.epub").write_bytes(b"not a zip")
    with pytest.raises(Exception, match="cannot read EPUB"):
        books.epub_books(books.files(spark, str(tmp_path / "bad.epub"))).collect()
    assert books.epub_books(books.files(spark, str(tmp_path / "bad.epub")), strict=False).first()["error"]
    with pytest.raises(FileNotFoundError):
        books.check_path(spark, str(tmp_path / "none.txt"))
    (tmp_path / "x.pdf").write_bytes(b"")
    with pytest.raises(ValueError, match="unsupported"):
        books.check_path(spark, str(tmp_path / "x.pdf"))
    with pytest.raises(ValueError, match="no input"):
        books.check_path(spark, "")


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "tale.txt").write_text('Chapter 1: Start\n\nIt was 1984. "Go!" she shouted.\n\nChapter 2\n\nThe end came.\n')
    out = str(tmp_path / "out")
    assert cli.main(["forge", str(folder / "tale.txt"), "--output", out, "--emotion", "--title", "T"], spark) == 0
    assert cli.main(["forge", str(folder / "tale.txt"), "--output", out, "--emotion", "--title", "T"], spark) == 0
    assert spark.read.parquet(f"{out}/state/audio").count() == 2  # the second run found all chunks done
    assert cli.main(["status", out], spark) == 0 and "2/2 chunks" in capsys.readouterr().out
    run = book.build(spark, str(folder / "tale.txt"))
    heard = run.chapters.select("book_id", "chapter_index", F.col("text").alias("transcript"), F.lit(1.0).alias("duration_seconds"))
    heard.write.parquet(str(tmp_path / "heard"))
    assert cli.main(["validate", out, "--input", str(folder / "tale.txt"), "--transcripts", str(tmp_path / "heard")], spark) == 0
    heard.withColumn("transcript", F.lit("something else")).write.parquet(str(tmp_path / "wrong"))
    assert cli.main(["validate", out, "--input", str(folder / "tale.txt"), "--transcripts", str(tmp_path / "wrong")], spark) == 1
    assert cli.main(["reset", out, "--yes"], spark) == 0 and cli.main(["status", out], spark) == 0
    assert cli.main(["forge", str(folder / "none.txt"), "--output", out], spark) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["forge"], spark)
    assert e.value.code == 2


TALE = 'Chapter 1: Start\n\nIt was 1984. "Go!" she shouted.\n\nChapter 2\n\nThe end came.\n'


def tool(tmp_path, monkeypatch):
    """A stand-in for the encoder: writes its arguments to the output."""
    folder = tmp_path / "bin"
    folder.mkdir()
    (folder / "ffmpeg").write_text('#!/bin/sh\nfor last; do :; done\necho "$@" > "$last"\n')
    (folder / "ffmpeg").chmod(0o755)
    monkeypatch.setenv("PATH", f"{folder}:{os.environ['PATH']}")


def test_a_run_ends_in_a_book(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "tale.txt").write_text(TALE)
    out, args = str(tmp_path / "out"), ["forge", str(tmp_path / "tale.txt"), "--output", str(tmp_path / "out"), "--title", "A/B", "--engine", "tone"]
    assert cli.main(args, spark) == 0 and not (tmp_path / "out" / "A_B.m4b").exists()
    parts = tmp_path / "out" / "books" / "A_B"
    assert {p.name for p in parts.iterdir()} == {"chapter_0000.wav", "chapter_0001.wav", "list.txt", "metadata.txt"}
    assert audio.samples((parts / "chapter_0000.wav").read_bytes())[1] == 22_050
    assert cli.main(["status", out], spark) == 0 and "2/2 chunks, 2/2 chapters, 100.0%" in capsys.readouterr().out
    tool(tmp_path, monkeypatch)
    assert cli.main(args, spark) == 0
    said = (tmp_path / "out" / "A_B.m4b").read_text()
    assert "-c:a aac -b:a 64k" in said and "stik=2" in said
    (tmp_path / "out" / "A_B.m4b").write_text("kept")
    assert cli.main(args, spark) == 0 and (tmp_path / "out" / "A_B.m4b").read_text() == "kept"
    assert "already assembled" in (tmp_path / "out" / "lectern.log").read_text()


def test_a_failing_chapter_is_skipped(spark, tmp_path, monkeypatch):
    class Broken(engines.ToneEngine):
        def synthesize(self, text, emotion, intensity, speed):
            return np.array(["no sound"], object) if "end" in text else super().synthesize(text, emotion, intensity, speed)

    class Absent(engines.ToneEngine):
        def initialize(self):
            raise RuntimeError("no model")

    (tmp_path / "tale.txt").write_text(TALE)
    monkeypatch.setitem(engines.ENGINES, "broken", Broken)
    monkeypatch.setitem(engines.ENGINES, "absent", Absent)
    out = str(tmp_path / "out")
    assert cli.main(["forge", str(tmp_path / "tale.txt"), "--output", out, "--engine", "broken"], spark) == 0
    assert [r["chapter_index"] for r in spark.read.parquet(f"{out}/chapters").collect()] == [0]
    assert cli.main(["forge", str(tmp_path / "tale.txt"), "--output", out, "--engine", "absent"], spark) == 1


def test_forge_validates_with_a_transcriber(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "tale.txt").write_text(TALE)
    out, seen = str(tmp_path / "out"), []
    monkeypatch.setitem(engines.TRANSCRIBERS, "fixed", lambda model: (seen.append(model), lambda: lambda content: "The end came.")[1])
    assert cli.main(["forge", str(tmp_path / "tale.txt"), "--output", out, "--validate", "--whisper-model", "small"], spark) == 0
    said = capsys.readouterr().out
    assert seen == ["small"] and "Whisper model: small" in said and "1 / 2 chapters" in said
    assert len(list((tmp_path / "out" / "transcripts").glob("book_id=*/chapter_index=*"))) == 2


def test_voice_reaches_its_engine():
    assert engines.get_engine("speech_api", "nova").voice == "nova" and engines.get_engine("tagged", "me.wav").reference == "me.wav"
    assert engines.get_engine("tone", "nova").name == "tone"


def test_covers_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, b"b"), (0, b"a")], "chapter_index int, content binary")
    paths = container.write_book(rows, str(tmp_path / "b"), ("jpg", b"picture"))
    assert [Path(p).read_bytes() for p in paths] == [b"a", b"b"] and (tmp_path / "b" / "coverjpg").read_bytes() == b"picture"


def test_post_processing_commands(monkeypatch):
    assert container.trim_command("a", "b")[4:6] == ["-af", "silenceremove=start_periods=1:start_silence=0.5:start_threshold=-40.0dB,areverse,silenceremove=start_periods=1:start_silence=0.5:start_threshold=-40.0dB,areverse"]
    seen = []
    monkeypatch.setattr(container, "run", lambda command: (seen.append(command), 'x {"input_i": "-30", "target_offset": "0.5"} y')[1])
    monkeypatch.setattr(Path, "unlink", lambda self: None)
    assert container.post_process("in.wav", "out.wav", rate=22_050) == "out.wav"
    assert [c[-1] for c in seen] == ["out.step0.wav", "-", "out.step1.wav", "out.wav"] and "measured_I=-30.0" in seen[2][-2] and "offset=0.5" in seen[2][-2]
    assert [c[c.index("-i") + 1] for c in seen] == ["in.wav", "out.step0.wav", "out.step0.wav", "out.step1.wav"]


def test_settings_that_cannot_be_read(monkeypatch):
    monkeypatch.setitem(sys.modules, "yaml", None)
    assert config.parse_yaml("a:\n  b: 'x # y'  # note\n  c: -2.5\nd: http://h/a#b # c\n") == {"a": {"b": "x # y", "c": -2.5}, "d": "http://h/a#b"}
    for bad in ("a:\n  - 1", "a: |\n  x", "a: [1]", "no pair"):
        with pytest.raises(ValueError, match="cannot read"):
            config.parse_yaml(bad)


def test_refined_annotation(spark):
    chapters = spark.createDataFrame([("b", 0, '"Go away," he said. Fine. It was calm.')], "book_id string, chapter_index int, text string")
    settings = config.Settings(engine="tagged", emotion=config.Emotion(enabled=True, mode="llm"))
    got = book.annotate(chapters, settings, engines.echo_client).orderBy("sentence_index").collect()
    assert [r["emotion"] for r in got] == ["curious", "neutral", "neutral"] and got[0]["intensity"] == 0.4
    assert book.refinement_mode(config.Settings(emotion=config.Emotion(enabled=True, mode="llm"))) == "rules"


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("One. Two.")
    for expected in (1, 2):
        drop.start(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        (folder / "b.txt").write_text("Three.")


def test_json_helpers(spark):
    row = spark.createDataFrame([('{"format": {"duration": "2.5"}}', 'x {"input_i": "-20.5"} y'), ('{"streams": [{"codec_type": "audio", "duration": "3"}]}', "none")], "p string, l string").select(audio.probe_duration(F.col("p")), audio.loudness_stats(F.col("l"))["input_i"]).collect()
    assert [tuple(r) for r in row] == [(2.5, -20.5), (3.0, -23.0)]
    assert json.loads(engines.echo_client()('{"sentences": [{"index": 4, "text": "t"}]}'))[0]["index"] == 4


def test_container(spark, tmp_path):
    assert container.assemble_command("l", "m", "o", cover="c.jpg")[-3:] == ["-metadata", "stik=2", "o"]
    assert "measured_I=-20.0:measured_TP=-2.0" in " ".join(container.loudness_command("a", "b", {"input_i": -20.0, "input_tp": -2.0, "input_lra": 7.0, "input_thresh": -33.0, "target_offset": 0.0}))
    with pytest.raises(RuntimeError, match="not installed"):
        container.run(["no-such-tool"])
    with pytest.raises(RuntimeError, match="failed"):
        container.run(["false"])
    with pytest.raises(RuntimeError, match="no chapter"):
        container.assemble([], "", "", str(tmp_path / "b.m4b"))
    df, seen = container.observed(spark.range(5))
    df.collect()
    assert seen.get["rows"] == 5


def test_segmenters(spark, caplog):
    rows = spark.createDataFrame([("b", 0, "One. Two.")], "book_id string, chapter_index int, text string")
    assert narration.segment(rows, "other").count() == 2 and "unknown segmenter" in caplog.text
    assert narration.segment(rows, "nltk").count() == 2
