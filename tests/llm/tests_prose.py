import random


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["stone", "river", "Cloud", "über", "tree", "wind", "salt", "lamp"]) + str(r.randrange(30)) for _ in range(n))
