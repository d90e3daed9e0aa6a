"""Short code blocks appended to the driver's prose so that every rule has something to find.

No backslashes: the same text is embedded in two SQL dialects.
"""

_long_body = "\n".join(f"    v{i} = v{i - 1} + {i}" for i in range(1, 56))
_many_methods = "\n".join(f"    def m{i}(self, x):\n        return x" for i in range(17))
_deep = "\n".join("    " * (d + 1) + f"if a > {d}:" for d in range(6)) + "\n" + "    " * 7 + "return a"
_branches = "\n".join(f"    {'if' if i == 0 else 'elif'} kind == {i}:\n        return {i}" for i in range(12))
_long_js = "\n".join(f"  let w{i} = {i};" for i in range(55))

PY = [
    """import os
from typing import List, Dict as D
def run_query(db, user):
    db.execute(f"SELECT * FROM t WHERE u = {user}")
    db.execute(f"INSERT INTO t VALUES ({user})")
    db.execute(f'UPDATE t SET u = {user}')
    db.execute(f'DELETE FROM t')
    db.execute("SELECT %s" % user)
    db.execute("SELECT " + user)
    return None""",
    """import pickle, yaml
import src.src0.m0
password = "my_secret_123"
secret = 'abc'
api_key = "sk-abc123def456"
private_key = "xyz"
token = "abcdefghijklmnopqrstuvwxyz"
data = pickle.loads(raw)
cfg = yaml.load(raw)
m = marshal.load(fh)
d = shelve.open(name)""",
    """import subprocess
async def fetch(url) -> str:
    subprocess.run(cmd, shell=True)
    os.system (cmd)
    os.popen(cmd)
    eval(expr)
    exec(code)
    requests.get("http://example.org")
    urllib.request.urlopen('http://example.org')
    return requests.post(url)""",
    """from hashlib import md5
import hashlib as hl
class Digest(Base):
    kind = 1
    @staticmethod
    def weak(data: bytes) -> str:
        h = hashlib.md5(data)
        k = hashlib.sha1 (data)
        return DES.new(key) or ARC4.new(key)
    async def later(self):
        await self.go()

    def go(self, *args):
        # eval( is only mentioned here
        return eval("1")""",
    """DEBUG = True
app.debug = True
app.run(host, debug=True)
CORS(app, origins="*")
resp.headers["Access-Control-Allow-Origin"] = "*"
allow_origins=["*"]
traceback.print_exc( )
def guard(e):
    raise ValueError(e)
    return str(e)
f = open(base + name)
p = os.path.join(root, request.args)
g = open( request.path)""",
    f"""def many(a, b, c, d, e, f, g):
{_long_body}
    return v55""",
    f"""class Huge(A, B, C, D):
{_many_methods}""",
    f"""def deep(a):
{_deep}

def branchy(kind) -> "int":
{_branches}
    return None""",
    """def loops(items, db):
    out = []
    text = ""
    global counter
    for item in items:
        f = open(item)
    for item in items:
        body = item.read()
    for item in items:
        fh.write(item)
    for item in items:
        requests.get(item)
    for item in items:
        urllib.parse(item)
    for item in items:
        db.execute(item)
    while items and not done:
        db.query(item)
    for a in items:
        for b in items:
            out.append(a)
            text += "x"
    time.sleep(5)
    big = [i for i in range(100000)]
    return out""",
    """class Prop:
    @property
    def total(self):
        s = 0
        for x in self.xs:
            s += x
        return s

    def label(self, a, b=1, *, c: int = 2) -> int:
        return a""",
    """# TODO: fix this later
# FIXME: broken
# HACK around
# XXX unclear
# import old_module
try:
    x = 1
except:
    pass
try:
    y = 2
except Exception:
    pass
try:
    z = 3
except ValueError as err:
    pass
path = "/usr/local/bin"
warnings.warn("deprecated", DeprecationWarning)""",
    """def wide(argument_number_one, argument_number_two, argument_number_three, argument_number_four_long):
    return 42
if __name__ == "__main__":
                                wide(1, 2, 3, 4)
with open(path) as fh:
    if a and b or c:
        total = a + 17""",
    """def helper():
    return 7

class Child(Parent, Mixin):
    def run(self):
        if self.ok:
            return helper()
        elif self.maybe:
            return guard(1)
        else:
            return weak(2)""",
]

JS = [
    """import React from 'react';
import { a, b } from "./util";
import './style.css';
const fs = require("fs");
function main(x) {
  if (x) { eval(x); }
  return new Function ("a");
}
class Widget extends Component {
  render() {
    el.innerHTML = x;
    el.outerHTML = y;
    document.write(z);
  }
}""",
    """const api = {
  load: async (url) => fetch(url),
  save: (x) => x,
};
// TODO: tidy
// FIXME later
// HACK
app.use(cors({ origin: "*" }));
CORS = "*"
async function pull(url) {
  while (more) { text += "x"; }
}
/* block */
 * star line""",
    f"""function longOne(a) {{
{_long_js}
}}
function shortOne(b) {{
  return b;
}}""",
    """class Plain {
  go(a, b) {
    for (const i of a) {
      switch (i) {
        case 1: return 10;
        default: try { b(); } catch (e) { console.warn(e); }
      }
    }
  }
}
password = 'hunter22'""",
]

GO = [
    """package main
import "fmt"
import (
    "os"
    "net/http"
)
type Server struct { port int }
func main() {
    for i := 0; i < 10; i++ { fmt.Println("/etc/hosts", i) }
}
// TODO: shutdown""",
    """package util
func Add(a int, b int) int {
    if a > 100 { return b }
    return a + b
}
// HACK""",
]

JAVA = [
    """import java.util.List;
public class Job extends Base {
    private String token = "abcdefghijklmnopqrstuvwxyz";
    public void run(int n) {
        if (n > 10) { log.warn ("n"); } else { go(); }
    }
}
// FIXME""",
    """public class Pojo {
    public int getX() {
        return 64;
    }
}""",
]

EXTENSIONS = [".py", ".js", ".ts", ".go", ".java"]
SLOTS = 13
PERIOD = len(EXTENSIONS) * SLOTS
_SETS = {".py": PY, ".js": JS, ".ts": JS, ".go": GO, ".java": JAVA}


def snippet_table() -> list[str]:
    """Snippet for each ``doc_id % PERIOD``."""
    out = []
    for i in range(PERIOD):
        pool = _SETS[EXTENSIONS[i % len(EXTENSIONS)]]
        out.append(pool[(i % SLOTS) % len(pool)])
    return out
