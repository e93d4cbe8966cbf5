"""Writers and exports."""
