x970