"""An engine in a folder: <table>.json holds its rows, `now` its clock. Without the folder it is down."""
import json
import os


class Client:
    def __init__(self, address):
        self.home = address

    def _text(self, name):
        if not os.path.isdir(self.home):
            raise ConnectionError(f"no engine at {os.path.basename(self.home)}")
        with open(os.path.join(self.home, name)) as f:
            return f.read()

    def now(self):
        return int(self._text("now"))

    def read(self, table, since_ns, until_ns):
        for r in json.loads(self._text(f"{table}.json")):
            if table == "logs" and r["raw"] == "!":
                raise OSError("configured logging driver does not support reading")
            if since_ns <= r.get("ts_ns", since_ns) < until_ns:
                yield r
