"""Time the registered queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query runs to completion through a no-op sink, so all columns are computed and nothing is collected to the driver.
BENCH_QUERIES may name a comma-separated subset.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "match_signatures_p1", "extract_fields_p3", "header_streams_p10", "classify_text_p7", "duration_p10", "explode_streams_p13", "first_stream_p14", "split_records_c1",
    "chunk_index_c2", "program_streams_c4", "assemble_c6", "pts_span_c7", "resolve_samples_c10", "cap_chunks_c11", "timing_c12", "frame_times_c12", "fill_durations_c14",
    "last_granule_c16", "packets_from_segments_c17", "frame_chain_c21", "inject_params_c22", "decode_pcm_a1", "frame_hashes_a4", "frame_hashes_by_chunk_a5", "resample_a9",
    "trim_a12", "tick_timing_v6", "frame_durations_v7", "composite_v9", "alpha_over_v10", "blend_frames_v10", "normalise_range_v16", "resize_nearest_v17", "expand_runs_v18",
    "image_manifest_v22", "normalise_oracle_q1", "diff_probe_q4", "diff_manifest_q6", "decide_q8", "first_success_q10", "status_summary_q11", "strict_metrics_q14", "area_rollup_q17",
    "failing_clusters_q26", "framehash_lines_s5", "remux_wav_s10",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from cinelake.plans.registry import load_all
    from cinelake.session import build_session

    spark = build_session("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    registry = load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    registry["status_summary_q11"].run(spark, sf_dir).collect()  # JVM warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip('/'))}))
    spark.stop()


if __name__ == "__main__":
    main()
