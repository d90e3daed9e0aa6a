x330