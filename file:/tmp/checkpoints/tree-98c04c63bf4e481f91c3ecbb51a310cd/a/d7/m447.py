x447