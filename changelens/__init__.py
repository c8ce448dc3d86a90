"""Change-review analytics on Spark: code facts, import graphs, risk ranking and review tables."""

#: One change (pull request) is identified by these two columns everywhere.
KEY = ["repo", "pr_number"]
