"""Archives by structure: any first tag, both line endings, every cut, frames of Zstandard files."""

import random

import pytest
import zstandard
from pyspark.sql import functions as F

from pairwright.sources import archive
from pairwright.sources.games import INPUT_ORDER, read_game_records, read_games, stream_game_records


def game(i, rng):
    tags = [f'[Event "e{i}"]', f'[Site "s{i}"]', f'[White "a{i}"]', f'[Result "1-0"]']
    rng.shuffle(tags)
    moves = "1. e4 {[%clk 0:03:00] [note]} e5" + "\n2. Nf3 Nc6" * rng.randint(0, 4)
    return "\n".join(tags) + "\n" * rng.choice([1, 2, 2, 3]) + moves + " 1-0\n" + "\n" * rng.choice([0, 1, 1, 2])


def archive_text(n, seed=1):
    rng = random.Random(seed)
    return [game(i, rng) for i in range(n)]


def owned(path, cuts, size):
    out = []
    for lo, hi in zip(cuts, [*cuts[1:], size]):
        out += [r.strip() for _, r in archive.records(str(path), lo, hi)]
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_cut_gives_every_record_once(tmp_path, end, monkeypatch):
    monkeypatch.setattr(archive, "READ_BYTES", 17)
    games = archive_text(9)
    data = "".join(games).replace("\n", end).encode()
    path = tmp_path / "x.pgn"
    path.write_bytes(data)
    want = [g.strip().replace("\n", end).encode() for g in games]
    for cut in range(1, len(data), 3):
        assert owned(path, [0, cut], len(data)) == want
    rng = random.Random(2)
    for _ in range(60):
        cuts = sorted({0, *(rng.randrange(len(data)) for _ in range(rng.randint(1, 30)))})
        assert owned(path, cuts, len(data)) == want


def test_five_games_that_begin_with_site(spark, tmp_path):
    (tmp_path / "s.pgn").write_text("\n".join(f'[Site "{i}"]\n[Event "x"]\n\n1. e4 e5 2. Nf3 1-0\n' for i in range(5)))
    games = read_games(spark, str(tmp_path))
    assert games.count() == 5 and games.filter("size(moves) = 3").count() == 5


def test_plain_and_framed_archives_agree(spark, tmp_path, monkeypatch):
    games = archive_text(120)
    data = "".join(games).encode()
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "g.pgn").write_bytes(data)
    # frames cut anywhere, a skippable frame between them, checksums and unknown sizes
    rng = random.Random(5)
    cuts = [0, *sorted(rng.sample(range(1, len(data)), 11)), len(data)]
    (tmp_path / "framed").mkdir()
    with open(tmp_path / "framed" / "g.pgn.zst", "wb") as f:
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            packer = zstandard.ZstdCompressor(write_checksum=k % 2 == 0, write_content_size=k % 3 == 0)
            f.write(packer.compress(data[lo:hi]))
            if k == 4:
                f.write((0x184D2A53).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc")
    plain = read_game_records(spark, str(tmp_path / "plain"), segment_bytes=700)
    framed = read_game_records(spark, str(tmp_path / "framed"))
    want = [g.strip() for g in games]
    assert [r.pgn for r in plain.orderBy(*INPUT_ORDER).collect()] == want
    assert [r.pgn for r in framed.orderBy(*INPUT_ORDER).collect()] == want
    assert framed.rdd.getNumPartitions() == 12 and framed.select("game_id").distinct().count() == 120
    # ids of a plain file do not depend on the cuts
    whole = read_game_records(spark, str(tmp_path / "plain"))
    assert plain.select("game_id").exceptAll(whole.select("game_id")).count() == 0
    # the stream gives the same records and ids
    q = stream_game_records(spark, str(tmp_path / "framed")).select("game_id", "pgn").writeStream.format("memory") \
        .queryName("framed_games").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("framed_games").exceptAll(framed.select("game_id", "pgn")).count() == 0
    assert spark.table("framed_games").count() == 120


def test_one_name_in_two_folders(spark, tmp_path):
    for k in ("a", "b"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "g.pgn").write_text("".join(archive_text(4, seed=ord(k))))
    recs = read_game_records(spark, str(tmp_path / "*")).count()
    assert recs == 8
    nested = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).count()
    assert nested == 2


@pytest.mark.parametrize("text", ['[Event "a"]\n\n[Event "b"]\n\n1. e4 *\n', '[Event "a"]\r\r1. e4 *\r\r[Event "b"]\r\r1. d4 *\r'])
def test_what_cannot_be_read_raises(spark, tmp_path, text):
    (tmp_path / "x.pgn").write_text(text, newline="")
    with pytest.raises(Exception, match="two blocks of tags|line endings"):
        read_game_records(spark, str(tmp_path)).select("pgn").collect()


def test_empty_archives(spark, tmp_path):
    (tmp_path / "x.pgn").write_text("")
    (tmp_path / "y.pgn").write_text("\n \n")
    assert read_game_records(spark, str(tmp_path)).count() == 0
    assert read_game_records(spark, str(tmp_path)).select(F.col("pgn")).columns == ["pgn"]


def test_a_torn_frame_raises(tmp_path):
    data = zstandard.ZstdCompressor().compress(b"[Event \"x\"]\n\n1. e4 *\n" * 50)
    (tmp_path / "x.zst").write_bytes(data[:-5])
    with pytest.raises(ValueError):
        archive.segments(str(tmp_path / "x.zst"))


def test_a_streamed_file_is_parsed_by_several_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pgn").write_text("\n".join(f'[Event "g{i}"]\n\n1. e4 e5 {i}\n' for i in range(60)))
    met = []
    recs = stream_game_records(spark, str(tmp_path / "in"), segment_bytes=100)
    query = recs.writeStream.foreachBatch(lambda b, _: met.extend(
        b.select(F.spark_partition_id().alias("p"), "pgn").collect())).option("checkpointLocation", str(tmp_path / "ck")) \
        .trigger(availableNow=True).start()
    query.awaitTermination()
    assert len({r.pgn for r in met}) == len(met) == 60 and len({r.p for r in met}) > 2
