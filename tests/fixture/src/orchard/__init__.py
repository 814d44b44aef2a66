"""An orchard, its trees and its books."""
