x907