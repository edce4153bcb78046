import csv
import glob

from conftest import write_tree

from toplist.cli import check_search_args, main


def test_search_argument_rules():
    assert check_search_args(None, None, None, None)
    assert check_search_args("a", None, "2020-01-01", 2020)
    assert check_search_args("a", None, None, 2020) is None
    assert main(["search", "--year", "1990"]) == 1


def test_cli_round_trip(spark, tmp_path, capsys):
    root = str(write_tree(tmp_path / "data"))
    idx = str(tmp_path / "idx")
    assert main(["--data", root, "--index", idx, "build-index"]) == 0
    assert main(["--data", root, "--index", idx, "show", "--date", "1990-01-06"]) == 0
    assert "Édith Piaf" in capsys.readouterr().out
    out = str(tmp_path / "cal")
    assert main(["--data", root, "--index", idx, "calendar", "--year", "2024", "--output", out]) == 0
    rows = []
    for part in sorted(glob.glob(f"{out}/part-*.csv")):
        with open(part, encoding="utf-8") as f:
            rows += list(csv.DictReader(f))
    assert rows and set(rows[0]) == {"week", "date", "original_date", "event"}
    assert main(["--data", root, "list"]) == 0
    assert "radio-top40" in capsys.readouterr().out


def test_listing_defaults_and_period_labels(spark, six):
    from toplist.cli import chart_listing, period_label
    from toplist.operators.anniversary import anniversary_hits

    charts = spark.createDataFrame(
        [("p", "c", "C", "weekly", None, None)],
        "provider string, name string, title string, frequency string, start_date string, end_date string",
    )
    r = chart_listing(charts).collect()[0]
    assert (r["start_date"], r["end_date"]) == ("????", "Present")
    labels = {x["artist"]: x["period"] for x in period_label(anniversary_hits(six, "2024-01-07")).collect()}
    assert labels == {"Artist A": "Jan 07", "Artist C": "Jan *", "Artist D": "Jan H1"}
    late = {x["artist"]: x["period"] for x in period_label(anniversary_hits(six, "2024-01-20")).collect()}
    assert late["Artist E"] == "Jan H2"


def test_cli_query_commands(spark, tmp_path, capsys):
    import os

    root = str(write_tree(tmp_path / "data2"))
    idx = str(tmp_path / "idx2")
    base = ["--data", root, "--index", idx]
    assert main(base + ["build-index"]) == 0
    capsys.readouterr()
    assert main(base + ["search", "--artist", "Beatls"]) == 0
    assert 'Hey "Jude"' in capsys.readouterr().out
    assert main(base + ["search", "--song", "vie en rose", "--best"]) == 0
    assert "best_rank" in capsys.readouterr().out
    assert main(base + ["peak", "--year", "1989", "--rank", "3"]) == 0
    assert "Lady Gaga" in capsys.readouterr().out
    assert main(base + ["anniversary", "--date", "2024-01-02"]) == 0
    out = capsys.readouterr().out
    assert "Bamboleo" in out and "Jan *" in out
    assert main(base + ["generate"]) == 0
    assert os.path.isdir(os.path.join(root, "descriptors", "catalog"))
