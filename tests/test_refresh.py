"""Incremental build: only what changed is read and written, and the index equals a full build."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

import pytest
from conftest import write_tree
from pyspark.sql import functions as F

from toplist.operators import refresh
from toplist.operators.index import build_search_index, read_index
from toplist.operators.refresh import read_manifest, refresh_search_index
from toplist.session import scratch_dir
from toplist.sources.tree_writer import write_csv_tree

HEADER = "date,this_week,artist,song,last_week\n"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(path):
    """Modification times of the index's data files, by directory."""
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def write(file: Path, text: str) -> None:
    """A file whose time differs from the one it replaces."""
    file.write_text(text, encoding="utf-8")
    now = time.time() + 60
    os.utime(file, (now, now))


@pytest.fixture
def tree(tmp_path):
    root = write_tree(tmp_path / "data")
    top = root / "radio" / "top40"
    write(top / "1991.csv", HEADER + "1991-01-05,1,A,B,\n1991-01-12,1,A,B,1\n")
    # The chart week at the end of a year stands in the next year's file.
    write(top / "1992.csv", HEADER + "1991-12-28,1,C,D,\n1992-01-04,1,C,D,1\n")
    return root


def test_one_changed_file_rewrites_its_directories(spark, tree):
    path = scratch_dir(spark, "index")
    first = refresh_search_index(spark, str(tree), path)
    assert first.full and len(first.changed) == 5
    before = files(path)
    again = refresh_search_index(spark, str(tree), path)
    assert (again.changed, again.removed, again.replaced, again.deleted) == ([], [], [], []) and files(path) == before

    write(tree / "radio" / "top40" / "1990.csv", HEADER + "1990-01-06,1,New,Song,\n")
    done = refresh_search_index(spark, str(tree), path)
    assert done.changed == ["radio/top40/1990.csv"] and done.replaced == [("radio", 1990)] and done.deleted == []
    after = files(path)
    same = {f for f in before if "year=1990" not in f}
    assert all(after[f] == before[f] for f in same) and {f for f in after if "year=1990" not in f} == same
    full = scratch_dir(spark, "index")
    build_search_index(spark, str(tree), full)
    # Rows of the other chart in the same directory are there too.
    assert rows(read_index(spark, path)) == rows(read_index(spark, full))


def test_shared_directories_removed_and_touched_files(spark, tree):
    path = scratch_dir(spark, "index")
    refresh_search_index(spark, str(tree), path)
    top = tree / "radio" / "top40"
    # 1991 loses its own file but keeps the week of the 1992 file; 1989 loses all rows.
    (top / "1991.csv").unlink()
    (top / "1989.csv").unlink()
    now = time.time() + 120
    os.utime(tree / "radio" / "latin" / "1990.csv", (now, now))
    done = refresh_search_index(spark, str(tree), path)
    assert done.removed == ["radio/top40/1989.csv", "radio/top40/1991.csv"]
    assert done.touched == ["radio/latin/1990.csv"] and done.changed == []
    assert done.replaced == [("radio", 1991)] and done.deleted == [("radio", 1989)]
    assert not any("year=1989" in f for f in files(path))
    full = scratch_dir(spark, "index")
    build_search_index(spark, str(tree), full)
    assert rows(read_index(spark, path)) == rows(read_index(spark, full))
    assert refresh_search_index(spark, str(tree), path).touched == []


def test_new_file_new_provider_and_changed_metadata(spark, tree):
    path = scratch_dir(spark, "index")
    refresh_search_index(spark, str(tree), path)
    other = tree / "télé +1%"
    (other / "hits").mkdir(parents=True)
    (other / "x-metadata.json").write_text(
        '{"name": "T", "prefix": "t", "charts": [{"name": "H", "folder": "hits", "prefix": "t-hits", '
        '"frequency": "weekly", "start_date": "1990-01-01", "fields": ["date", "this_week", "artist", "song"]}]}',
        encoding="utf-8",
    )
    write(other / "hits" / "1990.csv", "date,this_week,artist,song\n1990-02-03,1,E,F\n,2,No,Date\n")
    meta = tree / "radio" / "radio-metadata.json"
    meta.write_text(meta.read_text(encoding="utf-8").replace('"monthly"', '"fortnightly"'), encoding="utf-8")
    done = refresh_search_index(spark, str(tree), path)
    assert done.changed == ["radio/latin/1990.csv", "télé +1%/hits/1990.csv"]
    assert done.replaced == [("radio", 1990), ("télé +1%", None), ("télé +1%", 1990)]
    full = scratch_dir(spark, "index")
    build_search_index(spark, str(tree), full)
    assert rows(read_index(spark, path)) == rows(read_index(spark, full))
    # A directory of rows without a date goes with them.
    write(other / "hits" / "1990.csv", "date,this_week,artist,song\n1990-02-03,1,E,F\n")
    done = refresh_search_index(spark, str(tree), path)
    assert done.deleted == [("télé +1%", None)] and done.replaced == [("télé +1%", 1990)]
    build_search_index(spark, str(tree), full)
    assert rows(read_index(spark, path)) == rows(read_index(spark, full))


def test_manifest_and_failed_refresh(spark, tree):
    path = scratch_dir(spark, "index")
    assert read_manifest(spark, path) is None
    refresh_search_index(spark, str(tree), path)
    seen = {r["file"]: r for r in read_manifest(spark, path).collect()}
    assert {(p["provider"], p["year"]) for p in seen["radio/top40/1992.csv"]["parts"]} == {("radio", 1991), ("radio", 1992)}
    good = (tree / "radio" / "top40" / "1990.csv").read_text(encoding="utf-8")
    write(tree / "radio" / "top40" / "1990.csv", HEADER + "not a date,1,New,Song,\n")
    with pytest.raises(Exception, match="(?s)CAST_INVALID_INPUT|CANNOT_PARSE|not a date"):
        refresh_search_index(spark, str(tree), path)
    # The old manifest stands, so the next refresh sees the file again.
    write(tree / "radio" / "top40" / "1990.csv", good + "1990-02-03,1,Late,Entry,\n")
    assert refresh_search_index(spark, str(tree), path).changed == ["radio/top40/1990.csv"]
    full = scratch_dir(spark, "index")
    build_search_index(spark, str(tree), full)
    assert rows(read_index(spark, path)) == rows(read_index(spark, full))


def test_full_build_reads_the_tree_once_and_notes_every_part(spark, tmp_path, monkeypatch):
    days = [("p", "c", "1997-01-04"), ("p", "c", "1998-01-03"), ("q", "d", "1997-01-04"), ("q", "d", None)]
    rows = [(p, c, "weekly", day, 1, "A", "B") for p, c, day in days]
    entries = spark.createDataFrame(rows, "provider string, chart string, frequency string, date string, this_week long, artist string, song string")
    root, path, reads = str(tmp_path / "tree"), str(tmp_path / "index"), []
    write_csv_tree(entries.withColumn("date", F.to_date("date")), root)
    read = refresh.read_files
    monkeypatch.setattr(refresh, "read_files", lambda *a, **k: reads.append(a) or read(*a, **k))
    refresh.refresh_search_index(spark, root, path)
    assert len(reads) == 1
    found = {r["file"]: [tuple(x) for x in r["parts"]] for r in refresh.read_manifest(spark, path).collect()}
    assert found == {
        "p/c/1997.csv": [("p", 1997)], "p/c/1998.csv": [("p", 1998)], "q/d/1997.csv": [("q", 1997)], "q/d/undated.csv": [("q", None)],
    }


def test_full_build_of_files_without_rows(spark, tmp_path):
    root, path = tmp_path / "tree", str(tmp_path / "index")
    (root / "p" / "c").mkdir(parents=True)
    (root / "p" / "c" / "1997.csv").write_text("date,this_week,artist,song\n")
    chart = {"name": "c", "folder": "c", "prefix": "c", "frequency": "weekly", "start_date": "", "fields": ["date", "this_week", "artist", "song"]}
    (root / "p" / "p-metadata.json").write_text(json.dumps({"name": "p", "prefix": "p", "charts": [chart]}))
    assert refresh.refresh_search_index(spark, str(root), path).full
    assert [(r["file"], r["parts"]) for r in refresh.read_manifest(spark, path).collect()] == [("p/c/1997.csv", None)]
