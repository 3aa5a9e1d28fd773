"""CSV in the shape of the reference's sample table → read → safe clean →
profile (rows invented for the test)."""

import os
import tempfile

from pyspark.sql import types as T

from tablecare.operators.clean import safe_clean
from tablecare.operators.profile import profile
from tablecare.sources.files import read_csv

HEADER = ("Date,Team1,Team2,Score (Team1 - Team2),FullTimeResult,Venue,Attendance,"
          "Goal Scorers Team 1,Team 1 Possession percentage,Team 1: Shots on Goal\n")
ROWS = [
    '2025-12-21,Lions,Eagles,2 - 0,Lions,"North\nStadium",45000,"A. One, B. Two",55.5,7\n',
    "2025-12-22,Sharks,Bulls,1 - 1,Draw,East Arena,30000, ,48.0,3\n",
    "2025-12-23,Hawks,Foxes,0 - 3,Foxes,West Park,N/A,,41.2,2\n",
    "2025-12-24,Lions,Bulls,1 - 0,Lions,North Stadium,52000,C. Three,60.1,9,EXTRA\n",   # too many fields
    "2025-12-25,Eagles,Foxes,2 - 2,Draw,South Field,28000,D. Four\n",                  # too few fields
]


def test_sample_shaped_csv_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="tablecare-e2e-")
    path = os.path.join(d, "matches.csv")
    with open(path, "w") as f:
        f.write(HEADER + "".join(ROWS))
    raw = read_csv(spark, path)
    assert raw.count() == 4                           # the over-long row is skipped
    res = safe_clean(raw)
    df = res.df
    assert df.columns == ["date", "team1", "team2", "score_team1_team2", "full_time_result", "venue",
                          "attendance", "goal_scorers_team_1", "team_1_possession_percentage",
                          "team_1_shots_on_goal"]
    types = {f.name: f.dataType for f in df.schema.fields}
    assert isinstance(types["date"], T.TimestampNTZType)
    assert isinstance(types["attendance"], T.DoubleType)          # a missing token → float column
    assert isinstance(types["team_1_possession_percentage"], T.DoubleType)
    assert isinstance(types["score_team1_team2"], T.StringType)   # "2 - 0" is neither number nor date
    venues = sorted(r[0] for r in df.select("venue").collect())
    assert "North Stadium" in venues                  # quoted newline flattened
    short = df.where("team1 = 'Eagles'").first()
    assert short["team_1_possession_percentage"] is None        # short row padded with NULLs
    p = profile(df, "matches")
    assert set(p.datetime_cols) == {"date"} and "attendance" in p.numeric_cols
    assert p.column("goal_scorers_team_1")["missing_count"] == 2   # " " (token after trim) and ""
    assert p.column("team_1_shots_on_goal")["missing_count"] == 1  # padded short row
