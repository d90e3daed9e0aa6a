x607