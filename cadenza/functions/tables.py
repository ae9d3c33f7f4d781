"""Table functions for SQL: register(spark) makes them known to a session."""

from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="song long, first_bar int, past int, const int, future int")
class SongWindows:
    """song_windows(table(bars) partition by song order by (bar), past, const, future): the windows of each song.

    bars has (song, bar, n), each bar from 0 on once, n its notes. Windows follow each other past bars apart and hold
    past + const + future bars; a song needs one bar more than that. A window without notes in its middle part is left
    out. Rows are (song, first bar, notes of each part). No more than one window and a bar are held at a time.
    """

    def __init__(self):
        self.held: deque = deque()
        self.first = 0

    def eval(self, row, past: int, const: int, future: int):
        # A partition is one song; a new one begins with a new object.
        self.held.append(row["n"])
        whole = past + const + future
        if len(self.held) > whole:
            n = list(self.held)[:whole]
            middle = sum(n[past : past + const])
            if middle:
                yield row["song"], self.first, sum(n[:past]), middle, sum(n[past + const :])
            for _ in range(past):
                self.held.popleft()
            self.first += past


def register(spark: SparkSession) -> None:
    spark.udtf.register("song_windows", SongWindows)
