import random
import string

import duckdb
import test_secret_scan

from marlstone.llm import secret_scan as s
from marlstone.llm.queries import ORACLE_SQL, op2_secret_scan

R = random.Random(5)
LINES = ["".join(R.choice(string.ascii_letters + string.digits + "+/") for _ in range(n)) for n in (64, 64, 64, 64, 30)]
BODY = "\n".join(LINES) + "=="
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
HEAD = "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FFAA\n\n"
M = s.MASK
TEXTS = {
    f"Before {BEGIN}\n{BODY}\n{END} after": f"Before {M} after",
    f"{BEGIN}{HEAD}{BODY}\n{END}": M,
    f"{BEGIN}{HEAD}{BODY}": M,
    f"{BEGIN}\r\n{BODY}, the rest is lost": f"{M}, the rest is lost",
    f'"{BEGIN}\n{BODY}\n{END}\n"'.replace("\n", "\\n"): f'"{M}\\n"',
    f'"{BEGIN}\n{BODY}"'.replace("\n", "\\n"): f'"{M}"',
    f"{BEGIN}\n{BODY}\n{END}\nthen {BEGIN}\n{BODY}\n{END}": f"{M}\nthen {M}",
    f"Look for {BEGIN} in files - and for keys: {BEGIN}\n{BODY}\n{END}": f"Look for {M} in files - and for keys: {M}",
    f"-----BEGIN PUBLIC KEY-----\nshort\n{END}": f"-----BEGIN PUBLIC KEY-----\nshort\n{END}",
    f"{BEGIN}\n" + f"{'ZxY/' * 16}\n" * 5000: M,
}


def test_the_key_goes_with_its_header(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = s.find_secrets(df).withColumn("clean", s.redact(s.F.col("text"), s.F.col("spans"))).collect()
    assert {r.text: r.clean for r in got} == TEXTS
    assert all([tuple(x) for x in r.spans] == test_secret_scan.brute(r.text) for r in got)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rows = con.execute(ORACLE_SQL["op2_secret_scan"]).fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in op2_secret_scan(spark, str(tmp_path)).collect())
