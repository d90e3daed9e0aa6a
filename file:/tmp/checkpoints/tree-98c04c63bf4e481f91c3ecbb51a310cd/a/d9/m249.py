x249