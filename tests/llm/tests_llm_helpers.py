def components_of(links, nodes):
    """Smallest node of each node's component."""
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
