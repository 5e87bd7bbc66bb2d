"""Writers: tables as text files, dashboard specifications, scripts and role files, all made as DataFrames of text."""
