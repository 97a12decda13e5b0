"""Small tables of our own; what holds on them is computed by definition."""

VOYAGES = """ship,port,pilot,berth,day,cargo
Aster,Kiel,Ida,4,mon,salt
Borea,Kiel,Ida,4,tue,oats
Cinna,Riga,Jon,7,mon,salt
Aster,Kiel,Ida,5,wed,oats
Delos,Riga,Jon,7,thu,wool
Egret,Oslo,Kay,1,mon,tar
Fjord,Oslo,Lev,1,tue,tar
Cinna,Riga,Jon,7,fri,wool
Galle,Kiel,Ida,4,sat,hemp
Egret,Oslo,Kay,2,sun,tar
"""
READINGS = "Probe,Level\nnorth,low\nsouth,high\neast,low\nwest,none\n"
TILES = [(0, "oak", "long", "dark"), (1, "oak", "long", "pale"), (2, "elm", "long", "dark"), (3, "elm", "short", "dark"), (4, "oak", "short", "pale"), (5, "fir", "short", "pale")]
#: Greek and Cyrillic values.
LETTERS = [(0, "άλφα", "да"), (1, "άλφα", "нет"), (2, "βήτα", "да"), (3, "άλφα", "да"), (4, "γάμμα", "да")]
GRID = [("p", "1", "u", "f"), ("p", "2", "u", "g"), ("q", "1", "v", "f"), ("q", "3", "v", "h"), ("r", "2", "w", "g"), ("r", "2", "w", "g"), ("s", "3", "u", "h")]


def voyages(spark):
    lines = [x.split(",") for x in VOYAGES.strip().split("\n")]
    return spark.createDataFrame(lines[1:], lines[0])


def cells(text):
    return [tuple(x.split(",")) for x in text.strip().split("\n")[1:]]


def brute_partition(rows, at):
    """Positions of the rows that agree in the columns, of two rows and more."""
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(tuple(r[c] for c in at), []).append(i)
    return sorted(g for g in groups.values() if len(g) > 1)


def brute_alone(rows, rhs):
    """(g3, g1) of an empty left-hand side."""
    n = len(rows)
    sizes = {}
    for r in rows:
        sizes[r[rhs]] = sizes.get(r[rhs], 0) + 1
    return sum(c - 1 for c in sizes.values()) / (n - 1), sum(c * (c - 1) for c in sizes.values()) / (n * (n - 1))


def brute_errors(rows, lhs, rhs):
    """(g3, g1) of column positions lhs -> rhs by definition."""
    n = len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[i] for i in lhs), {}).setdefault(r[rhs], []).append(r)
    g3 = sum(sum(map(len, g.values())) - max(map(len, g.values())) for g in groups.values())
    g1 = sum(1 for a in range(n) for b in range(n) if a != b and all(rows[a][i] == rows[b][i] for i in lhs) and rows[a][rhs] != rows[b][rhs])
    return (g3 / (n - 1) if n > 1 else 0.0), (g1 / (n * (n - 1)) if n > 1 else 0.0)


def brute_minimal(rows, k, eps, which, max_lhs=None):
    """All minimal (lhs positions, rhs) with error <= eps."""
    from itertools import combinations

    out = {}
    for a in range(k):
        rest = [c for c in range(k) if c != a]
        valid = []
        for size in range(1, (max_lhs or k - 1) + 1):
            for x in combinations(rest, size):
                if any(set(v) <= set(x) for v in valid):
                    continue
                e = brute_errors(rows, x, a)[which]
                if e <= eps:
                    valid.append(x)
                    out[frozenset(x), a] = e
    return out
