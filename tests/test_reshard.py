"""Resharding without decoding, and commits that are broken off."""

import io
import os
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from tabloom.plans import reshard
from tabloom.sources import commit, tar


def put(path, members):
    with tarfile.open(path, "w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
                t.addfile(info)
            else:
                info.size = len(data)
                info.mtime = 12345
                t.addfile(info, io.BytesIO(data))


def contents(folder):
    out = []
    for _, _, name in commit.shard_files(str(folder)):
        with tarfile.open(name) as t:
            out += [(m.name, m.mtime, t.extractfile(m).read()) for m in t if m.isfile()]
    return out


@pytest.fixture
def folder(tmp_path):
    rnd = random.Random(1)
    os.makedirs(tmp_path / "in")
    for shard in range(3):
        members = []
        for i in range(40):
            key = f"part/{shard}-{i}" + ("-long" * 60 if i == 7 else "")
            members += [(f"{key}.json", rnd.randbytes(rnd.randrange(0, 3000))), (f"{key}.tag.txt", b"x" * rnd.randrange(5))]
            if i % 10 == 0:
                members.append((f"folder{i}", None))
        put(tmp_path / "in" / f"{shard:06d}.tar", members)
    put(tmp_path / "in" / "000003.tar", [("huge.json", rnd.randbytes(300_000)), ("small.json", b"1")])
    put(tmp_path / "in" / "000004.tar", [])
    return tmp_path


@pytest.mark.parametrize("layout", ["rename", "manifest"])
def test_members_come_out_whole_and_in_order(spark, folder, layout):
    before = contents(folder / "in")
    assert len(before) == 242
    made = reshard.reshard(spark, str(folder / "in"), 40_000, "new", layout=layout).collect()
    assert contents(folder / "in") == before
    assert len(made) > 6 and sorted(r["bytes"] for r in made)[-2] < 60_000
    names = sorted(n for _, _, found in os.walk(folder / "in") for n in found if n.endswith(".tar"))
    assert len(names) == len(made) and all(n.startswith("new-") for n in names)
    assert (layout == "manifest") == any(n.startswith(commit.PREFIX) for n in os.listdir(folder / "in"))
    for split in set(reshard.plan_shards(tar.read_index(spark, str(folder / "in")), 1).groupBy("key").count().collect()):
        assert split["count"] == 1  # files of one key stayed together
    # Back to one shard, elsewhere.
    again = reshard.reshard(spark, str(folder / "in"), 10**9, output=str(folder / "one")).collect()
    assert len(again) == 1 and contents(folder / "one") == before == contents(folder / "in")


def test_damage_changes_nothing(spark, folder):
    with open(folder / "in" / "000001.tar", "r+b") as f:
        f.seek(tarfile.BLOCKSIZE * 20)
        at = next(i for i in range(20, 400) if f.seek(512 * i) is not None and f.read(512)[257:262] == b"ustar")
        f.seek(512 * at)
        f.write(b"y" * 512)
    names = os.listdir(folder / "in")
    with pytest.raises(Exception, match="header"):
        reshard.reshard(spark, str(folder / "in"), 40_000)
    assert sorted(os.listdir(folder / "in")) == sorted(names)


def test_every_split_and_empty_folders(spark, folder):
    os.makedirs(folder / "root")
    os.rename(folder / "in", folder / "root" / "train")
    os.makedirs(folder / "root" / "test")
    put(folder / "root" / "test" / "a.tar", [("k.json", b"{}")])
    os.makedirs(folder / "root" / "none")
    before = contents(folder / "root")
    assert reshard.reshard_folders(spark, str(folder / "root"), 50_000, "p") == ["test", "train"]
    assert sorted(contents(folder / "root")) == sorted(before)
    assert os.listdir(folder / "root" / "test") == ["p-test-000000.tar"]
    put(folder / "empty.tar", [])
    assert reshard.reshard(spark, str(folder / "empty.tar"), 100, output=str(folder / "out")).count() == 0


class Broken(Exception):
    pass


@pytest.mark.parametrize("layout", ["rename", "manifest"])
@pytest.mark.parametrize("moves", range(6))
def test_a_commit_broken_off_shows_all_old_or_all_new(tmp_path, layout, moves):
    root = tmp_path / "s"
    os.makedirs(root)
    for i in range(3):
        put(root / f"{i:06d}.tar", [(f"old{i}.json", b"{}")])
    old = [f"old{i}.json" for i in range(3)]
    new = [f"new{i}.json" for i in range(4)]
    writer = tar.TarWriter({"path": str(root), "layout": layout}, type("S", (), {"fields": [type("F", (), {"name": "key"})]}), True)
    messages = []
    for i in range(4):
        temp = f"{writer.staging}/{i:06d}.abc.tar"
        name = f"{i:06d}.tar" if layout == "rename" else temp
        os.makedirs(root / writer.staging, exist_ok=True)
        put(root / temp, [(f"new{i}.json", b"{}")])
        messages.append(tar.Written(temp, name, 1))
    left = [moves]

    def move(fs, source, to):
        if not left[0]:
            raise Broken
        left[0] -= 1
        commit.move_file(fs, source, to)

    def seen():
        return [m.name for now, _, _ in commit.shard_files(str(root)) for m in tarfile.open(now)]

    writer.move = move
    try:
        writer.commit(messages)
    except Broken:
        pass
    assert seen() == (old if moves == 0 else new)
    if moves:
        commit.tidy(str(root))
        assert seen() == new
        assert len([n for _, _, found in os.walk(root) for n in found if n.endswith(".tar")]) == 4
        assert layout == "manifest" or sorted(os.listdir(root)) == [f"{i:06d}.tar" for i in range(4)]


def test_shards_are_read_while_a_commit_moves_them(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(50).select(F.col("id").cast("string").alias("key"), F.lit("{}").alias("json"))
    tar.write_tar(df.repartition(3), path, layout="manifest")
    assert tar.read_tar(spark, path, strict=True).count() == 50
    tar.write_tar(df.repartition(2), path, overwrite=True, layout="manifest")
    assert tar.read_tar(spark, path, strict=True).count() == 50
    assert len([n for _, _, found in os.walk(path) for n in found if n.endswith(".tar")]) == 2 and len(os.listdir(path)) == 2
    tar.write_tar(df.coalesce(1), path, overwrite=True)
    assert os.listdir(path) == ["000000.tar"]
    # A reader that listed a shard in the staging folder finds it under its plain name.
    fs, _ = tar.filesystem(path)
    with tar.open_shard(fs, f"{path}/_staging-x/gone", f"{path}/000000.tar") as f:
        assert f.size() > 0
