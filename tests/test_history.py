"""History rules on literal inputs, and the split of large keys against plain loops."""

import random

from pyspark.sql import functions as F

from opsloom import rules
from opsloom.functions import commands as cx
from opsloom.operators import history as hi
from opsloom.operators.ordered import seconds_bucket, running_last, with_position


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def ask(spark, expr, *values):
    df = rows(spark, "i int, t string", *enumerate(values)).select("i", expr(F.col("t")).alias("x")).orderBy("i")
    return [r.x for r in df.collect()]


def test_parse(spark):
    df = rows(spark, "id int, raw string", (1, ": 1700000000:0;cd /tmp\n: 1700000001:0;ls -la\n\n- cmd: id\n  pwd "))
    got = hi.parse_history(df).orderBy("line_no").collect()
    assert [(r.command, r.epoch) for r in got] == [("cd /tmp", 1700000000), ("ls -la", 1700000001), ("id", None), ("pwd", None)]


def test_technical(spark):
    got = ask(spark, cx.is_technical, "nmap -sV x", "sudo gobuster dir", "echo hello", "import os", "smbtool", "'nmap' x", "")
    assert got == [True, True, False, False, True, True, False]


def test_feedback(spark):
    got = ask(
        spark, cx.feedback_signal, "[-] Access denied for share", "id: uid=0(root) gid=0(root)", "Connection failed", "It looks like the exploit failed: try again",
        "timeout " + "x" * 300, "print('done')", "Done",
    )
    assert got == ["failure", "success", None, None, None, None, "success"]


def test_targets(spark):
    cases = {"cd lame": "lame", "cd Knife": "knife", "cd htb/Lame": "lame", "cd ~/htb/machines/Forest": "forest", "cd 'lame'": "lame", 'cd "Knife"': "knife", "cd /tmp": None, "cd ..": None, "cd -": None, "cd ~": None, "cd $HOME": None, "cd 8080": None, "cd " + "a" * 25: None, "ls -la": None, "": None}
    assert ask(spark, cx.cd_target, *cases) == list(cases.values())
    hosts = {"nmap -sV cap.htb": "cap", "curl http://Falafel.htb/login": "falafel", "ping host.htb": None, "curl http://localhost:80": None, "ping local.htb box.htb": "box"}
    assert ask(spark, cx.host_target, *hosts) == list(hosts.values())
    assert ask(spark, cx.needs_json_hint, "nmap -sV x", "nmap -sV x -oJ y", "sudo ffuf -u", "ls") == [True, False, True, False]


def test_phase_rule(spark):
    got = ask(spark, cx.command_phase, "nmap x", "masscan y", "nikto", "dirbuster", "python3 -c 'import pty'", "python3 payload.py", "id", "msfconsole", "ls", "linpeas && nmap")
    assert got == ["[RECON]", "[RECON]", "[ENUMERATION]", "[ENUMERATION]", "[EXPLOITATION]", "[EXPLOITATION]", "[POST-EXPLOITATION]", "[EXPLOITATION]", None, "[POST-EXPLOITATION]"]


def seq(spark, commands, secs=None, machine="m"):
    secs = secs or range(len(commands))
    return rows(spark, "machine string, sec bigint, seq bigint, command string", *[(machine, s, i, c) for i, (s, c) in enumerate(zip(secs, commands))])


def numbered(spark, commands, secs=None, width=3):
    return hi.number_commands(seq(spark, commands, secs), bucket=seconds_bucket("sec", width))


def test_phase_history(spark):
    for commands, phase in ((["nmap x", "ls"], "[RECON]"), (["msfconsole", "whoami", "id"], "[POST-EXPLOITATION]"), (["ls", "pwd"], "[IDLE]")):
        last = hi.running_phase(numbered(spark, commands), block_rows=60).orderBy(F.desc("pos")).first()
        assert last.phase == phase
    moved = hi.phase_changes(hi.running_phase(numbered(spark, ["ls", "nmap a", "nmap b", "nc c"]), block_rows=60)).orderBy("seq").collect()
    assert [(r.seq, r.previous_phase, r.phase) for r in moved] == [(1, "[IDLE]", "[RECON]"), (3, "[RECON]", "[EXPLOITATION]")]


def test_audit(spark):
    got = hi.methodology_audit(numbered(spark, ["searchsploit x", "nmap -sV y", "sqlmap z"]), block_rows=60).collect()
    assert [r.seq for r in got] == [0]


def test_retry_edges(spark):
    got = hi.retry_loop(numbered(spark, ["a"] * 4 + ["b"], [0, 29, 58, 87, 90])).orderBy("seq").collect()
    assert [(r.retries, r.retry_loop) for r in got] == [(0, False), (1, False), (2, False), (3, True), (0, False)]
    got = hi.retry_loop(numbered(spark, ["a"] * 3, [0, 30, 59])).orderBy("seq").collect()
    assert [r.retries for r in got] == [0, 0, 1]


def test_stall_and_hint_probes(spark):
    retried = hi.retry_loop(numbered(spark, ["a"], [1000]))
    probes = rows(spark, "machine string, sec bigint, probe_id bigint", ("m", 999, 1), ("m", 1401, 2), ("m", 1402, 3), ("m", 1599, 4), ("m", 1600, 5), ("other", 5, 6))
    got = {r.probe_id: r.state for r in hi.stall_state(retried, probes).collect()}
    assert got == {1: "idle", 2: "idle", 3: "stalling", 4: "stalling", 5: "stalled", 6: "idle"}
    p = rows(spark, "machine string, sec bigint, probe_id bigint", ("m", 1599, 1), ("m", 1600, 2), ("m", 2199, 3), ("m", 2200, 4))
    got = {r.probe_id: (r.hint_level, r.allow_web) for r in hi.hint_levels(seq(spark, ["nmap"], [1000]), p).collect()}
    assert got == {1: ("vague", False), 2: ("conceptual", False), 3: ("conceptual", False), 4: ("direct", True)}


def test_similar_and_stuck(spark):
    r = hi.similar_to_previous(numbered(spark, ["curl http://10.10.11.35/ip?ip=1.1.1.1; whoami", "curl 'http://10.10.11.35/ip?ip=1.1.1.1;id'", "nmap -p 80 10.0.0.1", "nmap -p 443 10.0.0.22", "nmap x"])).orderBy("seq").collect()
    assert [x.similar_input for x in r][1] and [x.similar_command for x in r] == [False, False, False, True, False]
    s = hi.stuck_status(numbered(spark, ["Trying command injection on /ip parameter", "Still testing command injection on ip"])).orderBy("seq").collect()
    assert "/ip parameter" in s[1].status and s[1].status == rules.STUCK_TEXTS[0]


def test_scoped_context(spark):
    many = seq(spark, [f"run{i}" for i in range(80)]).withColumn("cwd", F.lit("/x/box"))
    got = hi.scoped_context(many, bucket=seconds_bucket("sec", 7)).orderBy("seq").collect()
    assert [r.command for r in got] == [f"run{i}" for i in range(30, 80)]
    moved = seq(spark, ["cd sub", "alpha", "cd ..", "beta", "cd /else", "gamma", "cd ~", "delta"]).withColumn("cwd", F.lit("/x/box"))
    got = hi.scoped_context(moved, bucket=seconds_bucket("sec", 2)).orderBy("seq").collect()
    assert [r.command for r in got] == ["cd sub", "cd ..", "beta", "cd /else"]


def test_aggregates(spark):
    used = rows(spark, "machine string, service string", *[("m", "FTP")] * 20, *[("m", "http")] * 25, *[("m", "dns")] * 19, *[("n", "ftp")] * 30)
    sol = rows(spark, "machine string, service string", ("m", "HTTP"))
    assert [(r.machine, r.service, r.n_commands) for r in hi.rabbit_hole(used, sol).collect()] == [("m", "ftp", 20)]
    c = seq(spark, ["nmap a", "smbclient //10.0.0.5/x -p 445 smb", "ls"])
    assert hi.recon_summary(c).first().recon_summary == "that weird SMB share on 10.0.0.5"
    m = rows(spark, "machine string, e int", ("a", 1), ("a", 0), ("a", 0), ("a", 0), ("b", 2))
    assert {r.machine: r.meter for r in hi.usage_meter(m, F.col("e") == 1, F.col("e") == 0).collect()} == {"a": 2, "b": 0}
    t = hi.target_switch(numbered(spark, ["cd lame", "ls", "nmap lame.htb", "cd Cap", "cd cap"]), block_rows=2).orderBy("seq").collect()
    assert [(r.seq, r.target) for r in t] == [(0, "lame"), (3, "cap")]


# ---------------------------------------------------------------- large keys
def hot(spark, n=3000, seed=1):
    """One machine holds a third of all rows, ties in time included."""
    rnd = random.Random(seed)
    data, clock = [], {}
    for i in range(n):
        machine = "hot" if rnd.random() < 0.34 else f"m{rnd.randrange(40)}"
        clock[machine] = clock.get(machine, 0) + rnd.choice([0, 0, 1, 3, 9, 31])
        data.append((machine, clock[machine], i, rnd.choice(["nmap a", "ls", "whoami", "nc b", "failed: x", "done y"])))
    return data, spark.createDataFrame(data, "machine string, sec bigint, seq bigint, command string")


def by_machine(data):
    out = {}
    for row in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(row[0], []).append(row)
    return out


def test_positions_and_running_last(spark):
    data, df = hot(spark)
    n = with_position(df, ["machine"], ["sec", "seq"], seconds_bucket("sec", 40), total="n")
    want = {r[2]: (i, len(rs)) for rs in by_machine(data).values() for i, r in enumerate(rs)}
    assert {r.seq: (r.pos, r.n) for r in n.collect()} == want
    last = running_last(n, ["machine"], F.when(F.col("command") == "nc b", F.col("seq")), "last", block_rows=16)
    expect = {}
    for rs in by_machine(data).values():
        v = None
        for r in rs:
            v = r[2] if r[3] == "nc b" else v
            expect[r[2]] = v
    assert {r.seq: r["last"] for r in last.collect()} == expect


def test_cooldown_against_loop(spark):
    data, df = hot(spark, seed=5)
    for seconds, width in ((30, 50), (30, 7), (10, 1000)):
        got = {r.seq for r in hi.cooldown(df, seconds, bucket=seconds_bucket("sec", width)).filter("fired").collect()}
        want = set()
        for rs in by_machine(data).values():
            last = None
            for r in rs:
                if last is None or r[1] - last >= seconds:
                    last = r[1]
                    want.add(r[2])
        assert got == want


def test_guarded_cooldown_against_loop(spark):
    data, df = hot(spark, seed=9)
    for limit in (200, 2):
        got = {r.seq for r in hi.guarded_cooldown(df, 10, line="command", seen_limit=limit).collect()}
        want = set()
        for rs in by_machine(data).values():
            last, seen = None, set()
            for r in rs:
                if (last is None or r[1] - last >= 10) and r[3] not in seen:
                    last = r[1]
                    seen.add(r[3])
                    want.add(r[2])
                    if len(seen) > limit:
                        seen.clear()
        assert got == want


def test_context_of_a_large_key(spark):
    data, df = hot(spark, seed=3)
    n = hi.number_commands(df, bucket=seconds_bucket("sec", 40))
    got = {r.seq: r.context for r in hi.rolling_context(n, size=7, block_rows=16).collect()}
    want = {r[2]: [x[3] for x in rs[max(0, i - 6) : i + 1]] for rs in by_machine(data).values() for i, r in enumerate(rs)}
    assert got == want
