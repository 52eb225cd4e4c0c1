from tessera.streaming import ingest_gpu_log, snapshot
from tessera.sources.fs import write_bytes

HEADER = "utilization.gpu [%], memory.used [MiB]"


def test_ingest_then_snapshot(spark, tmp_shared):
    logs = tmp_shared("live")
    table = tmp_shared("tbl")
    ck = tmp_shared("ck")
    lines = []
    for i in range(6):
        lines += [HEADER, f"{i} %, {i * 10} MiB", f"{i + 1} %, 40 MiB"]
    write_bytes(f"{logs}/a.log", ("\n".join(lines[:9]) + "\n").encode())
    write_bytes(f"{logs}/b.log", ("\n".join(lines[9:]) + "\n").encode())
    q = ingest_gpu_log(spark, logs, table, ck, available_now=True)
    q.awaitTermination(120)
    st, means, series = snapshot(spark, table, max_history=100)
    rows = sorted((r["step"], r["gpu"], r["util"]) for r in st.collect())
    assert len(rows) == 12 and rows[0] == (0, 0, 0) and rows[-1] == (5, 1, 6)
    assert series.count() == 300
