from __future__ import annotations

import json

from plumbline.streaming import audit


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    rows = [{"ts": f"2024-01-01T{h:02d}:{m:02d}:00Z", "decision": "block" if (h + m) % 3 else "proceed", "package": f"p{m % 4}"} for h in range(5) for m in range(0, 60, 7)]
    for k in range(3):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k::3]) + "\n{torn")
    log = audit.read_log(spark, str(folder))
    want = {tuple(r) for r in audit.windowed_counts(log, "decision").collect()}
    stream = audit.windowed_counts(audit.read_log_stream(spark, str(folder)), "decision")
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("select * from counts").collect()}
    assert got == want and sum(r[2] for r in got) == len(rows)
    assert audit.tail(log, 5).count() == 5
    assert audit.sessions(log, "package").count() > 0
    assert audit.distinct_entries(log, ["package"]).count() == 4
