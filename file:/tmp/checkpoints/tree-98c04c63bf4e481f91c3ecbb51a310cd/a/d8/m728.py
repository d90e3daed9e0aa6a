x728