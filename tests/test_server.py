import json
import threading
import urllib.request
from urllib.error import HTTPError

from palimpsest.plans.store import Engine, Options
from palimpsest.server import serve

TABLE = {"table": "t", "business_key": "id", "schema": [{"name": "id", "type": "string"}, {"name": "v", "type": "long"}], "quality_gates": [{"column": "v", "rule": "between 0 and 100"}], "on_row_error": "quarantine"}


def test_requests(spark, tmp_path):
    with Engine(spark, str(tmp_path / "db"), Options(buckets=1)) as e:
        server = serve(e, 0)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_address[1]}"

        def ask(path, body=None):
            try:
                with urllib.request.urlopen(urllib.request.Request(base + path, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})) as r:
                    return r.status, r.read().decode()
            except HTTPError as x:
                return x.code, x.read().decode()

        assert ask("/")[0] == 200 and ask("/api/tables", TABLE)[0] == 201 and ask("/api/tables", TABLE)[0] == 409 and ask("/api/tables", {"table": "x"})[0] == 400
        status, out = ask("/api/tables/t/apply?load_id=1", [{"id": "a", "v": 1}, {"id": "b", "v": 2}, {"id": "c", "v": 500}])
        assert status == 200 and json.loads(out)["tables"]["t"]["inserts"] == 2
        assert ask("/api/tables/t/apply?load_id=1", [{"id": "z", "v": 1}])[0] == 409
        rows = json.loads(ask("/api/tables/t/rows?limit=1")[1])
        assert rows["has_more"] and rows["rows"][0]["id"] == "a" and len(json.loads(ask("/api/tables/t/rows?q=%22B%22")[1])["rows"]) == 1
        assert len(json.loads(ask("/api/tables/t/history?id=a")[1])) == 1 and ask("/api/tables/t/history?id=q")[0] == 404
        assert len(json.loads(ask("/api/quarantine?table=t")[1])) == 1 and json.loads(ask("/api/verify")[1])["tables"]["t"]["entities"] == 2
        assert ask("/api/tables/none")[0] == 404 and ask("/api/nothing")[0] == 404 and json.loads(ask("/api/stats")[1])["inserts"] == 2 and json.loads(ask("/api/tables")[1]) == ["t"]
        server.shutdown()
