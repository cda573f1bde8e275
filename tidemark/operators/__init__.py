"""Jobs on DataFrames: cohort, orders, profile, browsing, communication, behaviour, modelling."""
