from catchwater.sources import adapters as A


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def test_breaker_and_deadline():
    c = Clock()
    b, d, seen = A.Breaker(60, c), A.Deadline(45, c), []

    def fetch(timeout):
        seen.append(timeout)
        c.now += 40
        raise A.Unavailable(trip=len(seen) == 2)

    assert A.call("p", fetch, b, d) is None and seen == [10.0, 5.0]
    assert not b.allows("p") and b.allows("q") and d.left() == 0
    c.now += 61
    assert b.allows("p") and A.call("p", lambda t: [1], b, A.Deadline(1, c)) == [1]
    assert A.call("p", lambda t: (_ for _ in ()).throw(A.Unavailable(retry=False)), b, A.Deadline(1, c)) is None


def test_pace():
    c = Clock()
    p = A.Pace(1.0, c, c.sleep)
    assert p.wait(A.Deadline(5, c)) and p.wait(A.Deadline(5, c)) and c.now == 1.0
    assert not p.wait(A.Deadline(0.5, c))


def test_batches_keep_order():
    assert A.in_batches([*range(7)], 3, lambda b: [x * 2 for x in b]) == [0, 2, 4, 6, 8, 10, 12]


def test_failures_by_status():
    assert A.failure(429).trip and A.failure(503).trip and A.failure(429).retry
    assert not A.failure(500).trip and A.failure(500).retry and A.failure("timeout").retry
    assert A.failure("connect").trip and not A.failure("connect").retry and not A.failure("malformed").retry
    b = A.Breaker(60, clock=lambda: 0.0)

    def refuse(timeout):
        raise A.failure(503)

    assert A.call("x", refuse, b, A.Deadline(9, clock=lambda: 0.0)) is None and not b.allows("x")


def test_batches_run_at_once_and_keep_order():
    import threading

    seen, lock, both = [], threading.Lock(), threading.Barrier(2, timeout=20)

    def fetch(batch):
        if batch[0] < 4:
            both.wait()
        with lock:
            seen.append(batch)
        return None if batch[0] == 4 else [x * 10 for x in batch][: 1 if batch[0] == 6 else None]

    assert A.in_batches(list(range(9)), 2, fetch) == [0, 10, 20, 30, None, None, None, None, 80] and len(seen) == 5
