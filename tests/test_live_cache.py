"""The live cache over batches of a stream."""

import json

from pagewright.streaming import live_cache


def test_requests_share_decodes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live_cache.PROVIDER)
    source = tmp_path / "in"
    source.mkdir()
    at = lambda t: f"2024-01-01T{t // 60:02}:{t % 60:02}:00Z"
    ask = lambda n, key, t: {"number": n, "key": key, "ts": at(t)}
    done = lambda key, t, ok, result: {"key": key, "ts": at(t), "ok": ok, "result": result}
    batches = [[ask(1, "a", 1), ask(2, "a", 2), ask(3, "b", 2), ask(4, None, 3)], [done("a", 4, True, "pic"), ask(5, "a", 5), ask(6, "b", 5)], [done("b", 6, False, "damaged"), ask(7, "b", 7), ask(8, "c", 7), ask(9, "c", 7)]]

    def run(name, rows):
        (source / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        stream = spark.readStream.schema("number long, key string, ts timestamp, ok boolean, result string").json(str(source))
        q = live_cache.answered(stream, 60 * 60_000).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(60) or q.stop()
        assert q.exception() is None

    for i, rows in enumerate(batches):
        run(i, rows)
    read = lambda: {r.number: (r.key, r.what, r.ok, r.result) for r in spark.read.schema(live_cache.SCHEMA).json(str(tmp_path / "out")).collect()}
    got = read()
    assert got == {1: ("a", "decode", None, None), 2: ("a", "shared", True, "pic"), 3: ("b", "decode", None, None), 5: ("a", "hit", True, "pic"), 6: ("b", "shared", False, "damaged"), 7: ("b", "hit", False, "damaged"), 8: ("c", "decode", None, None)}
    run("later", [ask(10, "a", 50), ask(11, "d", 140)])  # a hit; the watermark passes the hour without use of a
    run("last", [ask(12, "a", 141), ask(13, "c", 142)])
    got = read()
    assert got[10][1] == "hit" and got[12][1] == "decode" and got[9][1] == "decode" and got[13][1] == "decode"
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
