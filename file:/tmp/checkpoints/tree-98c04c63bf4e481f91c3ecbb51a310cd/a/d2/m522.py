x522