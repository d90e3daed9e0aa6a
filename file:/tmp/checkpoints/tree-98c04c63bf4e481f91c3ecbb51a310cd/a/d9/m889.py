x889