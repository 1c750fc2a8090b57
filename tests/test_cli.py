import json
from datetime import datetime

from touchline import cli
from touchline.plans.pipelines import Config
from touchline.schemas import TABLES
from touchline.session import scratch
from touchline.sources import landing

T0 = datetime(2024, 1, 1)


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "m.yaml").write_text("countries:\n- country: X\n  leagues:\n  - name: L\n")
    for endpoint, name, items in (
        ("leagues", "country-X_name-L", [{"league": {"id": 7, "name": "L"}, "seasons": [{"year": "2024", "start": "2024-08-01", "end": "2099-05-01"}]}]),
        ("teams", "league-7_season-2024", [{"team": {"id": i, "name": f"t{i}", "code": None}} for i in (1, 2)]),
        ("standings", "league-7_season-2024", [{"league": {"standings": [[{"team": {"id": i, "name": f"t{i}"}, "rank": i} for i in (1, 2)]]}}]),
    ):
        (tmp_path / "api" / endpoint).mkdir(parents=True)
        (tmp_path / "api" / endpoint / f"{name}.json").write_text(json.dumps({"response": items}))
    common = ["--root", f"{tmp_path}/land", "--warehouse", f"{tmp_path}/wh", "--folder", f"{tmp_path}/api"]

    def run(*command):
        assert cli.main([*common, *command]) == 0
        return json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert run("metadata", f"{tmp_path}/m.yaml")["teams"] == 2
    assert run("standings") == {"command": "standings", "rows": 2}
    assert run("full-load")["failed"] == 1
    assert run("replay") == {"command": "replay", "replayed": 0, "left": 1}
    assert run("update") == {"command": "update", "received": 0}
    assert run("correct", "--mode", "changed")["moved"] == 0
    assert run("build", f"{tmp_path}/out", "int_league_context", "mart_dim_search", "--threads", "2")["built"] == ["int_league_context", "mart_dim_search"]
    assert landing.published(spark, f"{tmp_path}/out", "mart_dim_search").count() == 3
    assert cli.main([*common, "metadata", f"{tmp_path}/none.yaml"]) == 1


def test_loads_leave_no_intermediate_tables(spark, tmp_path):
    from touchline.session import _OPEN, materialise

    with scratch(spark):
        df = materialise(spark.range(3), "x")
        path = df.inputFiles()[0]
        assert df.count() == 3
    assert not __import__("os").path.exists(path.replace("file://", "")) and path not in _OPEN
    landing.publish(spark.createDataFrame([], TABLES["dim_leagues"]), f"{tmp_path}/wh", "dim_leagues")
    assert Config(f"{tmp_path}/land", f"{tmp_path}/wh").transport()["lanes"] == "1"
