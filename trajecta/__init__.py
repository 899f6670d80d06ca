"""Cohort trajectories and territorial specificity on Spark DataFrames.

Every operator takes and returns DataFrames.  The vocabulary is the same throughout:
``entity`` and ``grp`` name what is counted (a name and a sex, a part and a status),
``period`` is an integer time step, ``territory`` a place code and ``n`` the count.
"""
