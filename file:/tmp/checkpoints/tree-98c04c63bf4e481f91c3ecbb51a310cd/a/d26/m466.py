x466