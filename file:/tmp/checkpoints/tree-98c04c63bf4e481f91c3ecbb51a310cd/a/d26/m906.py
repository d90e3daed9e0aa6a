x906