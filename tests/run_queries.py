"""Run registered queries against their SQL: ``python tests/run_queries.py [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, connect  # noqa: E402

from pyspark.sql import SparkSession  # noqa: E402

from barloom.plans import registry  # noqa: E402
from barloom.session import build_session  # noqa: E402


def main(argv):
    sf = "/root/testdata/sf0.01"
    want, plain = [], False
    for a in argv:
        if a.startswith("sf="):
            sf = "/root/testdata/" + a[3:]
        elif a == "plain":
            plain = True
        elif a.startswith("mod="):
            registry.MODULES = tuple(a[4:].split(","))
        else:
            want.append(a)
    qs = registry.load_all()
    if len(registry.MODULES) < 4:
        own = {f"barloom.plans.{m}" for m in registry.MODULES}
        qs = {k: q for k, q in qs.items() if q.run.__module__ in own}
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false"}
    if plain:  # nothing of our own settings, as an outside caller would start it
        b = SparkSession.builder.appName("check").master("local[8]")
        for k, v in conf.items():
            b = b.config(k, v)
        spark = b.getOrCreate()
    else:
        spark = build_session("check", "local[8]", conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, q in qs.items():
        if want and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in want):
            continue
        t = time.time()
        try:
            if q.sql:
                ok, msg = compare(q.run(spark, sf), con, q.sql)
            else:
                n = len(q.run(spark, sf).collect())
                ok, msg = n > 0, f"{n} rows (no SQL)"
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:38s} {time.time() - t:6.2f}s {msg}", flush=True)
    print("failures:", bad)


main(sys.argv[1:])
