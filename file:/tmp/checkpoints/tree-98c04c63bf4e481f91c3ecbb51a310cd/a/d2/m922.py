x922