import json

from tidewater.operators import delivery
from tidewater.schemas import ALERTS


def test_requests_and_outcomes(spark):
    a = spark.createDataFrame([("a1", "r", "errors", "log", "h", "c", "web", "3 matches", "boom", 3, 0, 5)], ALERTS)
    ch = spark.createDataFrame([("c1", "webhook", "w", True, "http://x/y", "", ""), ("c2", "gotify", "g", True, "http://g/", "tok", ""), ("c3", "telegram", "t", True, "", "bot", "42"), ("c4", "ntfy", "n", False, "http://n", "", ""), ("c5", "fax", "f", True, "", "", "")], delivery.CHANNELS)
    got = {r.channel_id: r for r in delivery.requests(a, ch).collect()}
    assert set(got) == {"c1", "c2", "c3"} and got["c2"].url == "http://g/message" and got["c2"].headers["X-Gotify-Key"] == "tok"
    assert json.loads(got["c3"].body) == {"chat_id": "42", "text": "Alert: errors: 3 matches (h/web)"} and json.loads(got["c1"].body)["alert"]["count"] == 3
    t = spark.createDataFrame([("a1", "c1", 1, None, "dial bot: no", "bot"), ("a1", "c1", 2, 200, None, "bot"), ("a1", "c2", 1, 503, None, ""), ("a1", "c3", 1, None, "dial bot: no", "bot")], "alert_id string, channel_id string, attempt int, http_status int, error string, secret string")
    out = {r.channel_id: (r.status, r.error) for r in delivery.outcomes(t).collect()}
    assert out == {"c1": ("ok", None), "c2": ("failed", "channel returned 503"), "c3": ("failed", "dial ***: no")}
    assert sorted(r.channel_id for r in delivery.retryable(t).collect()) == ["c2", "c3"]
