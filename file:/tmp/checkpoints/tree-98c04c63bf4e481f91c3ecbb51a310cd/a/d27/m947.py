x947