import pytest
from pyspark.sql import functions as F

from clipledger.operators import dataset as ds
from clipledger.operators import labels as lb
from clipledger.operators import roster as ro
from clipledger.plans.labels import _converted, build_roster_query
from clipledger.plans.views import Views

ACT = "clip_id string, action_index int, player string, color string, action string, result boolean, assisted boolean, other_player string"
DOC = "clip_id string, numerosity bigint, action_count bigint"
TRK = "clip_id string, track_id string, is_object boolean, n_frames int, jersey_color string, jersey_number string"
SHOT = ("c", 0, "13", "white", "2PT  Shot", True, True, "20")


def codes(df):
    return sorted(r.code for r in df.collect())


def test_assisted_shot_gives_two_labels(frame):
    labels, anomalies = lb.map_documents(frame([("c", 1, 1)], DOC), frame([SHOT], ACT))
    assert sorted((r.jersey_number, r.label) for r in labels.collect()) == [("13", "Made Shot"), ("20", "ast")]
    assert codes(anomalies) == []


def test_two_labels_of_one_player_are_removed(frame):
    actions = [("c", 0, "2", "white", "2PT Shot", False, None, None), ("c", 1, "2", "white", "Rebound", None, None, None)]
    labels, anomalies = lb.map_documents(frame([("c", 2, 2)], DOC), frame(actions, ACT))
    assert labels.count() == 0 and codes(anomalies) == ["MULTI_LABEL_ACTOR"]


def test_every_mapping_problem_has_its_code(frame):
    actions = [
        ("c", 0, "3", "black", "Violation", None, None, None),
        ("c", 1, None, "black", "Foul", None, None, None),
        ("c", 2, "4", "black", "3PT Shot", None, None, None),
        ("c", 3, "5", "black", "2pt shot", True, True, "x"),
        ("c", 4, "6", "black", "STEAL", None, None, None),
        ("c", 5, "6", "black", "steal", None, None, None),
    ]
    documents = frame([("c", 9, 6), ("d", 0, 0), ("e", 1, None)], DOC)
    labels, anomalies = lb.map_documents(documents, frame(actions, ACT))
    assert sorted((r.jersey_number, r.label) for r in labels.collect()) == [("5", "Made Shot"), ("6", "steal")]
    assert codes(anomalies) == [
        "DUPLICATE_LABEL_COLLAPSED", "INVALID_ACTION_DOCUMENT", "INVALID_ACTION_IDENTITY", "MISSING_ASSISTANT_IDENTITY",
        "MISSING_SHOT_RESULT", "NO_STRUCTURED_ACTION", "NUMEROSITY_MISMATCH", "UNMAPPED_ACTION",
    ]
    assert {r.code: r.n for r in lb.count_anomalies(anomalies).collect()}["UNMAPPED_ACTION"] == 1


def build(frame, tracks):
    labels, anomalies = lb.map_documents(frame([("c", 1, 1)], DOC), frame([SHOT], ACT))
    return lb.build_annotations(frame([("c",)], "clip_id string"), labels, anomalies, frame(tracks, TRK))


BALL = ("c", "ball", True, 1, None, None)


def test_uninvolved_player_stays_as_background(frame):
    built = build(
        frame,
        [("c", "player_0", True, 3, " White", "13"), ("c", "player_1", True, 3, "white", "20"), ("c", "player_2", True, 3, "black", "28"), BALL],
    )
    assert {r.track_id: r.label for r in built["annotations"].collect()} == {
        "player_0": "Made Shot", "player_1": "ast", "player_2": None, "ball": None
    }


@pytest.mark.parametrize(
    "tracks,code",
    [
        ([("c", "player_0", True, 3, "white", "13"), ("c", "player_1", True, 3, "white", "13"), BALL], "AMBIGUOUS_TRACK_IDENTITY"),
        ([("c", "player_0", True, 3, "white", "13"), ("c", "ball", True, 0, None, None)], "MISSING_BALL_TRACK"),
        ([("c", "player_0", True, 3, "white", None), BALL], "UNRESOLVED_TRACK_IDENTITY"),
        ([("c", "player_0", True, 0, "white", "13"), BALL], "MISSING_PLAYER_TRAJECTORY"),
        ([("c", "player_0", False, 3, "white", "13"), BALL], "INVALID_TRACK_PAYLOAD"),
        ([BALL], "UNMATCHED_GT_ACTOR"),
    ],
)
def test_clip_with_an_error_is_excluded(frame, tracks, code):
    built = build(frame, tracks)
    assert code in codes(built["anomalies"])
    assert [r.status for r in built["verdicts"].collect()] == ["excluded"]
    assert built["annotations"].count() == 0


def test_batch_skips_finished_and_retries_excluded(frame):
    clips = frame([("c", True, True), ("d", False, True), ("e", True, False), ("f", True, True)], "clip_id string, has_action boolean, has_tracks boolean")
    reports = frame([("f", "accepted", True), ("d", "excluded", True)], "clip_id string, status string, has_annotation boolean")
    tracks = frame([("c", "player_0", True, 3, "white", "13"), ("c", "player_1", True, 3, "white", "20"), BALL], TRK)
    args = (clips, frame([("c", 1, 1)], DOC), frame([SHOT], ACT), tracks, reports)
    batch = lb.label_batch(*args)
    assert {r.clip_id: r.status for r in batch["verdicts"].collect()} == {"c": "accepted", "d": "excluded", "e": "excluded"}
    assert codes(batch["anomalies"]) == ["MISSING_ACTION_DOCUMENT", "MISSING_CLEAN_TRACK"]
    (summary,) = lb.batch_summary(batch).collect()
    assert (summary.processed, summary.accepted, summary.excluded, summary.skipped_existing_reports) == (3, 1, 2, 1)
    again = lb.label_batch(*args, overwrite=True)
    assert again["verdicts"].count() == 4
    assert {r.clip_id for r in again["stale_annotations"].collect()} == {"d", "f"}


def test_roster_keeps_double_zero_and_flags_ambiguity(frame):
    games = frame([("bkn-vs-det-0022400861", ["BRK", "det"], True)], "game string, teams array<string>, has_players boolean")
    players = frame(
        [("bkn-vs-det-0022400861", i, True, t, n, j) for i, (t, n, j) in enumerate(
            [("DET", "A", ["00"]), ("DET", "B", ["00", "00"]), ("BRK", "C", ["0"]), ("XXX", "D", ["1"]), ("BRK", "E", []), ("BRK", "", ["2"])]
        )],
        "game string, player_index int, is_object boolean, team string, name string, jersey_numbers array<string>",
    )
    raw = frame([("bkn-vs-det-0022400861", {"brk": "White", "DET": "black"})], "game string, colors map<string,string>")
    result = ro.convert_roster(games, players, ro.team_colors(raw))
    rows = [(r.team, r.jersey, r.name) for r in result["players"].orderBy("sort_key").collect()]
    assert rows == [("BRK", "0", "C"), ("DET", "00", "A"), ("DET", "00", "B")]
    assert codes(result["anomalies"]) == [
        "AMBIGUOUS_SEASON_ROSTER_IDENTITY", "INCOMPLETE_ROSTER_PLAYER", "PLAYER_WITHOUT_JERSEY", "UNKNOWN_PLAYER_TEAM"
    ]
    assert result["verdicts"].collect()[0].status == "accepted"
    missing = ro.convert_roster(games, players, ro.team_colors(raw).filter("team = 'BRK'"))
    assert codes(missing["anomalies"]) == ["MISSING_TEAM_COLOR"]
    assert missing["players"].count() == 0


@pytest.mark.parametrize("n,expected", [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (1, 1, 1)), (10, (6, 2, 2)), (20, (14, 3, 3))])
def test_split_counts(frame, n, expected):
    games = frame([(f"g{i}",) for i in range(n)], "game string")
    counts = {r.split: r["count"] for r in ds.split_games(games, 0.7, 0.15, 1).groupBy("split").count().collect()}
    assert tuple(counts.get(s, 0) for s in ("train", "valid", "test")) == expected


def test_split_is_repeatable_and_validated(frame):
    games = frame([(f"g{i}",) for i in range(9)], "game string")
    first = {r.game: r.split for r in ds.split_games(games, 0.6, 0.2, 4).collect()}
    assert first == {r.game: r.split for r in ds.split_games(games.repartition(5), 0.6, 0.2, 4).collect()}
    document = frame([(["g1"], None, ["g1", "zz"])], "train array<string>, valid array<string>, test array<string>")
    problems = {(r.problem, r.game) for r in ds.validate_split(document, games).collect()}
    assert problems == {("missing_split", "valid"), ("game_in_several_splits", "g1"), ("game_not_staged", "zz")}
    with pytest.raises(ValueError):
        ds.split_games(games, 0.9, 0.1, 4)


def test_selection_keeps_the_requested_order(frame):
    games = frame([("b",), ("a",), ("c",)], "game string")
    assert [r.game for r in ds.select_games(games, ["c", "a", "c"]).collect()] == ["c", "a"]
    assert [r.game for r in ds.select_games(games, limit=2).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="unknown game"):
        ds.select_games(games, ["q"]).collect()


def test_manifest_and_gaps(frame):
    game = "bkn-vs-det-0022400861"
    paths = [f"{game}/video/1.mp4", f"{game}/description/action/1.json", f"{game}/description/GT caption/1.txt",
             f"{game}/description/players/roster.json", f"{game}/video/2.mp4", "loose/video/3.mp4"]
    files = frame([(p,) for p in paths], "path string")
    found, unknown = ds.discover_games(files, frame([(game,), ("none",)], "game string"))
    assert [r.game for r in found.collect()] == [game] and [r.game for r in unknown.collect()] == ["none"]
    manifest = ds.clip_manifest(files.filter(F.col("path").startswith(game)))
    rows = {r.video_name: r for r in manifest.collect()}
    assert rows["1"].gt_caption == "description/GT caption/1.txt" and rows["2"].action is None
    assert rows["2"].roster == "description/players/roster.json" and rows["1"].game_id == "0022400861"
    (gaps,) = ds.manifest_gaps(manifest).collect()
    assert (gaps.clips, gaps.missing_pbp, gaps.missing_action, gaps.missing_roster) == (2, 2, 1, 0)


def test_runtime_export(frame):
    splits = frame([("train", "a-vs-b-0000000001"), ("test", "c-vs-d-0000000001"), ("valid", "e-vs-f-0000000002")], "split string, game string")
    videos = frame([("a-vs-b-0000000001", "1"), ("a-vs-b-0000000001", "2"), ("c-vs-d-0000000001", "9")], "game string, video_name string")
    export = ds.export_runtime(splits, videos, videos.filter("video_name = '1'"))
    assert {r.video_name: r.status for r in export["manifest"].collect()} == {
        "1": "exported", "2": "skipped_missing_annotation", "9": "skipped_missing_annotation"
    }
    assert {(r.problem, r["item"]) for r in export["problems"].collect()} == {
        ("shared_game_id", "0000000001"), ("no_videos", "e-vs-f-0000000002")
    }
    assert {r.split: (r.clips, r.missing_annotations) for r in export["summary"].collect()} == {"train": (2, 1), "test": (1, 1), "valid": (0, 0)}


def test_verdicts_of_rosters_read_no_players(frame):
    games = frame([("g1", ["A", "B"], True), ("g2", ["A", "C"], True), ("g3", None, True)], "game string, teams array<string>, has_players boolean")
    colors = frame([("g1", "A", "white"), ("g1", "B", "red"), ("g2", "A", "white")], "game string, team string, color string")
    players = frame([("g1", 0, True, "A", "x", ["1"])], "game string, player_index int, is_object boolean, team string, name string, jersey_numbers array<string>")
    unread = players.withColumn("name", F.raise_error(F.lit("players were read")).cast("string"))
    verdicts = ro.convert_roster(games, unread, colors)["verdicts"]
    assert sorted(map(tuple, verdicts.collect())) == [("g1", "accepted"), ("g2", "excluded"), ("g3", "excluded")]


def test_players_of_one_team_are_dealt_to_many_tasks(spark, frame):
    games = frame([(f"aa-vs-bb-{i:010d}",) for i in range(20)], "game string")
    players = frame([("AA", f"p{i}", "s", "1", "") for i in range(200)], "team string, name string, short_name string, number string, number2 string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        built = ro.build_roster(games, players).withColumn("task", F.spark_partition_id())
        rows = built.groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in rows) == 4000
    assert len(rows) == 3 and max(r["count"] for r in rows) < 2500


def test_rosters_of_one_kind_are_converted_once_and_told_for_each_game(spark, frame):
    counts = frame([("r1", "X", 2), ("r2", "Y", 1)], "scope_id string, code string, n bigint")
    members = frame([("g1", "r1"), ("g2", "r1"), ("g3", "r2"), ("g4", "r3")], "game string, roster string")
    told = ro.for_games(counts, members, "scope_id")
    assert sorted(map(tuple, told.collect())) == [("g1", "X", 2), ("g2", "X", 2), ("g3", "Y", 1)]
    orders = "SELECT id AS o_orderkey, id * 50 AS o_custkey, 1D AS o_totalprice FROM range(140)"
    customers = "SELECT id AS c_custkey, cast(id % 25 AS int) AS c_nationkey, 'n' || id AS c_name, 's' AS c_mktsegment, 100D * id AS c_acctbal FROM range(50)"

    class Small(Views):
        def table(self, name):
            return spark.sql(orders if name == "orders" else customers)

    converted, games = _converted(Small(spark, ""))
    assert games.select("game").distinct().count() == 140
    assert converted["verdicts"].count() == 35


def test_a_row_is_read_once_for_all_games_and_a_game_named_once(spark, frame):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    rows = frame([("r1", "X")], "roster string, name string")
    members = frame([("g1", "r1"), ("g2", "r1")], "game string, roster string")
    each = ro.for_each(rows, members, "roster")
    assert sorted((r["game"], r["name"]) for r in each.collect()) == [("g1", "X"), ("g2", "X")]
    # the join's first side is walked once, the second once for each row of the first
    assert plan(each).index("xxhash64") < plan(each).index("explode")

    class Small(Views):
        def table(self, name):
            return spark.sql("SELECT id AS o_orderkey, id div 3 * 50 AS o_custkey, 1D * id AS o_totalprice FROM range(30)")

    views = Small(spark, "")
    games = sorted(map(tuple, views.games.collect()))
    assert games == sorted(map(tuple, views.game_orders.groupBy("game", "gi").agg(F.max("o_totalprice")).collect())) and len(games) == 10
    below = plan(views.games).split("Aggregate")[1].split("\n", 1)[1]
    assert "o_totalprice" in below and "format_string" not in below


def test_numbers_are_joined_to_text_once_for_all_games_of_a_player(spark):
    orders = "SELECT id AS o_orderkey, id * 50 AS o_custkey, 1D AS o_totalprice FROM range(14)"
    customers = "SELECT id AS c_custkey, cast(id % 25 AS int) AS c_nationkey, 'n' || id AS c_name, 's' AS c_mktsegment, 100D * id AS c_acctbal FROM range(70)"

    class Small(Views):
        def table(self, name):
            return spark.sql(orders if name == "orders" else customers)

    built = build_roster_query(Small(spark, ""))
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("array_join")
    assert {r.jersey_numbers for r in built.filter("name IN ('n0', 'n7', 'n60')").collect()} == {"", "7", "60,06"}
    assert built.count() == built.distinct().count() == 2 * 70


def test_small_sides_of_a_large_result_keep_their_tasks(spark):
    rows = spark.sql("SELECT 'r' || id % 5 AS roster, 'n' || id AS name FROM range(100)")
    members = spark.sql("SELECT 'g' || id AS game, 'r' || id % 5 AS roster FROM range(100)")
    each = ro.for_each(rows, members, "roster").withColumn("task", F.spark_partition_id())
    assert each.select("task").distinct().count() == 3 and each.count() == 2000
    plan = each._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("ENSURE_REQUIREMENTS") == 1


def test_players_of_a_shared_roster_are_listed_for_each_game(frame):
    rosters = frame([("r", ["A"], True)], "game string, teams array<string>, has_players boolean")
    colors = frame([("r", "A", "white")], "game string, team string, color string")
    players = frame(
        [("r", 0, True, "A", "x", ["1", "2"]), ("r", 1, True, "A", "x", ["1"]), ("r", 2, True, "A", "y", ["0"])],
        "game string, player_index int, is_object boolean, team string, name string, jersey_numbers array<string>",
    )
    members = frame([("g1", "r"), ("g2", "r"), ("g3", "none")], "game string, roster string")
    listed = ro.for_games(ro.convert_roster(rosters, players, colors)["players"].drop("sort_key"), members)
    one = [("A", "white", "x", "1"), ("A", "white", "x", "2"), ("A", "white", "y", "0")]
    assert sorted(tuple(r[c] for c in ("game", "team", "color", "name", "jersey")) for r in listed.collect()) == [
        (g, *row) for g in ("g1", "g2") for row in one
    ]


def test_labels_and_anomalies_share_the_groups_written_once(frame):
    labels, anomalies = lb.map_documents(frame([("c", 1, 1)], DOC), frame([SHOT, SHOT], ACT))
    for rows in (labels, anomalies):
        assert "Aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert labels.count() == 2 and codes(anomalies) == ["DUPLICATE_LABEL_COLLAPSED"] * 2
