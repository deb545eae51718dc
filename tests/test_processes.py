"""Processes on a small graph."""

from tessera.operators import processes


def test_flows_from_a_user_interface(spark):
    symbols = spark.createDataFrame(
        [
            ("route", "GET /orders/:id", "r1", '{"path": "/Orders/[id]/", "http_method": "GET"}'), ("route", "POST /orders/:id", "r0", '{"path": "/orders/:id", "http_method": "POST"}'),
            ("route", "ANY /bare", "r2", None), ("function", "h", "m.h", None), ("function", "s", "m.s", None),
        ],
        "kind string, name string, qname string, extras string",
    )
    edges = spark.createDataFrame(
        [
            (1, "ui.a", None, "http::GET /orders/:key", "FETCHES", 0.75, 0, '{"http_method": "get", "url": "/orders/:key"}'), (2, "ui.a", None, "http::GET /orders/:key", "FETCHES", 0.75, 0, None),
            (3, "ui.b", "c.bare", "/bare", "FETCHES", 0.5, 0, "bad"), (4, "ui.c", None, "http::PUT /none", "FETCHES", 0.9, 0, None), (5, "ui.d", None, "/bare", "FETCHES", 0.4, 0, None),
            (6, "r1", "m.h", "h", "HANDLES_ROUTE", 0.9, 0, None), (7, "m.h", "m.s", "s", "CALLS", 0.6, 0, None),
        ],
        "edge_id long, src string, dst string, dst_name string, edge_type string, confidence double, precision_level int, metadata_json string",
    )
    got = {(r.entrypoint, r.path, r.terminal, r.n_steps, round(r.confidence, 4)) for r in processes.build(symbols, edges).where("process_type = 'ui_to_api_flow'").collect()}
    whole = round((0.75 * 0.8 * 0.9 * 0.6) ** 0.25, 4)
    assert got == {
        ("ui.a", "ui.a > http::GET /orders/:key > r1 > m.h > m.s", "m.s", 4, whole), ("ui.b", "ui.b > c.bare > r2", "r2", 2, round((0.5 * 0.8) ** 0.5, 4)),
        ("ui.c", "ui.c > http::PUT /none", "http::PUT /none", 1, 0.9),
    }
