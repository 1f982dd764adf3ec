"""Sources and sinks: RIFF/WAVE files as DataFrames and back."""
