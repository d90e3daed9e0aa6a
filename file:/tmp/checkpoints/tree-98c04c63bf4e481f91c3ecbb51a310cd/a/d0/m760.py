x760