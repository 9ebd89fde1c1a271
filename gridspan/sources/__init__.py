"""Sources and sinks: workbooks and delimited text."""
