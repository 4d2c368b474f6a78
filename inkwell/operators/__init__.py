"""What is computed: functions from DataFrames to DataFrames."""
