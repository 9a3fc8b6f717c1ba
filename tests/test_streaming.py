import random

from clipledger.operators import timeline as tl
from clipledger.streaming.timeline import CLAIM, EventMerge, close_stream, run_merge
from test_timeline import CAND, crowded_candidates, greedy


def as_claim(row):
    names = [x.split()[0] for x in CAND.split(", ")]
    held = dict(zip(names, row))
    return tuple(held[x] for x in CLAIM)


def test_state_of_one_video_matches_the_ordered_rule_whatever_the_batches():
    for seed in range(200):
        rng = random.Random(seed)
        rows = sorted(crowded_candidates(seed, "v", 40), key=lambda r: r[10])
        state, mark, final = (), 0.0, []
        for k in range(0, 40, 8):
            batch = [as_claim(r) for r in rows[k : k + 8]]
            rng.shuffle(batch)
            merger = EventMerge(0.5, *state)
            merger.add(batch)
            final += merger.advance(mark := max(mark, rows[k][10]))
            state = merger.state(mark)
        final += EventMerge(0.5, *state).advance(1e9)
        groups = {}
        for claim in final:
            groups.setdefault(claim[-1], []).append(claim[0])
        assert sorted(tuple(sorted(x)) for x in groups.values()) == sorted(tuple(sorted(x)) for _, x in greedy(rows, 0.5))


def test_stream_goes_on_after_a_stop_and_drops_what_is_too_late(spark, frame, tmp_path):
    rows = [r for k in range(5) for r in crowded_candidates(k, f"v{k}", 40)]
    late = ("late", "v0", "v0_00000", "player_9", None, "Foul", 0.5, 0.5, 0.0, 1.0, 0.0, 1.0)
    folder = str(tmp_path / "in")

    def write(some):
        frame(some, CAND).coalesce(1).write.mode("append").parquet(folder)

    def run():
        return run_merge(spark, folder, frame([], CAND).schema, str(tmp_path / "out"), str(tmp_path / "check"), delay_seconds=12.0)

    for low, high in ((0, 12), (12, 24)):
        write([r for r in rows if low <= r[10] < high])
    first = run().count()
    for low, high in ((24, 36), (36, 1000)):
        write([r for r in rows if low <= r[10] < high])
    write([late])
    for _ in range(2):
        close_stream(frame([], CAND)).write.mode("append").parquet(folder)
    done = run()
    missing = {r[0] for r in rows} - {r.candidate_id for r in done.collect()}
    assert not missing, sorted((r[10], r[11], r[0]) for r in rows if r[0] in missing)
    assert 0 < first < done.count() == len(rows)
    merged = tl.summarise(done).select("event_id", "candidate_ids").collect()
    assert sorted((r.event_id, tuple(r.candidate_ids)) for r in merged) == sorted(greedy(rows, 0.5))
    assert run().count() == len(rows)


def test_many_videos_share_a_bucket_and_a_batch_takes_several_files(spark, frame, tmp_path):
    rows = [r for k in range(7) for r in crowded_candidates(k, f"v{k}", 20)]
    folder = str(tmp_path / "in")
    for low, high in ((0, 12), (12, 24), (24, 1000)):
        frame([r for r in rows if low <= r[10] < high], CAND).repartition(2).write.mode("append").parquet(folder)
    for _ in range(2):
        close_stream(frame([], CAND), files=2).write.mode("append").parquet(folder)
    paths = (str(tmp_path / x) for x in ("out", "check"))
    done = run_merge(spark, folder, frame([], CAND).schema, *paths, delay_seconds=12.0, files=2, buckets=2)
    merged = tl.summarise(done).select("event_id", "candidate_ids").collect()
    assert sorted((r.event_id, tuple(r.candidate_ids)) for r in merged) == sorted(greedy(rows, 0.5))
