"""Solutions, project files and C# sources as DataFrames."""
