"""Sources: catalogue and interaction loaders, JDBC/Parquet connectors, feedback intake."""
